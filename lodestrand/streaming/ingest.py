"""Streaming ingest: frames, metadata and settled candidates from chunks that keep arriving.

State lives in the stateful operator's store: what the frame scan hasn't finished, elapsed time, the open title, candidates
that wait. Records of several fields are kept as JSON, which other versions can read and add to. The batch operators give the
same rows over the same chunks. A stream's end is a row of its own, as no timer can tell it from a pause.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrand import on_workers
from lodestrand.sources.framing import Demux, FrameScan


def _in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True).sort_values("seq", ignore_index=True)


def frames(chunks: DataFrame, codec: str) -> DataFrame:
    """Frames of streaming chunks(stream_id, seq, data); a stream's chunks arrive in order."""

    def step(key, pdfs, state: GroupState):
        scan = FrameScan(codec, *(state.get if state.exists else (0, 0.0, b"")))
        rows = [(key[0], *f) for data in _in_order(pdfs)["data"] for f in scan.feed(bytes(data))]
        state.update((scan.offset, scan.elapsed, scan.pending))
        yield pd.DataFrame(rows, columns=["stream_id", "codec", "offset", "length", "sample_rate", "samples", "time_seconds"])

    on_workers()
    kind = dict(chunks.dtypes)["stream_id"]
    schema = f"stream_id {kind}, codec string, offset long, length int, sample_rate int, samples int, time_seconds double"
    return chunks.groupBy("stream_id").applyInPandasWithState(step, schema, "offset long, elapsed double, pending binary", "append", GroupStateTimeout.NoTimeout)


def demuxed(chunks: DataFrame, interval: int) -> DataFrame:
    """Audio and titles of streaming chunks with interleaved metadata."""

    def step(key, pdfs, state: GroupState):
        demux = Demux(interval)
        if state.exists:
            held = json.loads(state.get[0])
            demux.left, demux.need, demux.clean, demux.block = held["left"], held["need"], held["clean"], base64.b64decode(held["block"])
        rows = []
        for seq, data in _in_order(pdfs)[["seq", "data"]].itertuples(index=False):
            audio, events = demux.feed(bytes(data))
            rows.append((key[0], seq, audio, [{"title": t, "audio_offset": o} for t, o in events]))
        state.update((json.dumps({"left": demux.left, "need": demux.need, "clean": demux.clean, "block": base64.b64encode(demux.block).decode()}),))
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "audio", "events"])

    on_workers()
    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, seq long, audio binary, events array<struct<title: string, audio_offset: long>>", "demux string", "append", GroupStateTimeout.NoTimeout)


class TitleTracker:
    """Lifetimes of titles: a decision when a title ends, a track once one has lasted `threshold`."""

    def __init__(self, threshold: float):
        self.threshold, self.title, self.start, self.confirmed = threshold, None, None, False

    def feed(self, title: str, t: float) -> list[tuple[str, str, float, float]]:
        """(what, title, start, at): what is HARD_CUT or NO_BOUNDARY for a title that ended, TRACK for one that is confirmed."""
        if self.start is None:
            self.title, self.start = title, t
            return []
        lasted = t - self.start
        if lasted < 0:
            raise ValueError("metadata events must be in order of time")
        out = []
        if title != self.title:
            out.append(("HARD_CUT" if self.confirmed or lasted >= self.threshold else "NO_BOUNDARY", self.title, self.start, t))
        if not self.confirmed and lasted >= self.threshold:
            self.confirmed = True
            out.append(("TRACK", self.title, self.start, t))
        if title != self.title:
            self.title, self.start, self.confirmed = title, t, False
        return out

    def clock(self, t: float) -> list[tuple[str, str, float, float]]:
        """The open title as a TRACK if the stream has gone on for long enough."""
        if self.start is None or self.confirmed or t - self.start < self.threshold:
            return []
        self.confirmed = True
        return [("TRACK", self.title, self.start, t)]


def titles(events: DataFrame, threshold: float) -> DataFrame:
    """stream_id, what, title, start_t, at_t of streaming events(stream_id, seq, title, t). An event without a title is the clock: how far the stream has come."""

    def step(key, pdfs, state: GroupState):
        tracker = TitleTracker(threshold)
        if state.exists:
            tracker.title, tracker.start, tracker.confirmed = json.loads(state.get[0])
        rows = []
        for title, t in _in_order(pdfs)[["title", "t"]].itertuples(index=False):
            rows += [(key[0], *r) for r in (tracker.clock(float(t)) if title is None else tracker.feed(title, float(t)))]
        state.update((json.dumps([tracker.title, tracker.start, tracker.confirmed]),))
        yield pd.DataFrame(rows, columns=["stream_id", "what", "title", "start_t", "at_t"])

    on_workers()
    kind = dict(events.dtypes)["stream_id"]
    return events.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, what string, title string, start_t double, at_t double", "tracker string", "append", GroupStateTimeout.NoTimeout)


class SettleQueue:
    """Candidates that wait until the stream has gone on for `settle` seconds past them; late ones are never dropped."""

    def __init__(self, settle: float):
        self.settle, self.end, self.waiting = settle, 0.0, []

    def feed(self, candidates: list[float], end: float | None) -> list[float]:
        self.end = max(self.end, end or 0.0)
        self.waiting = sorted(self.waiting + candidates)
        ready = [t for t in self.waiting if self.end >= t + self.settle]
        self.waiting = self.waiting[len(ready) :]
        return ready

    def flush(self) -> list[float]:
        ready, self.waiting = self.waiting, []
        return ready


def settled(rows: DataFrame, settle: float) -> DataFrame:
    """Ready candidates of streaming rows(stream_id, seq, candidate_s or null, end_s or null); an end_s of infinity ends the stream, and what waits is ready."""

    def step(key, pdfs, state: GroupState):
        queue = SettleQueue(settle)
        if state.exists:
            queue.end, queue.waiting = json.loads(state.get[0])
        pdf = _in_order(pdfs)
        end = pdf["end_s"].max()
        over = end == float("inf")
        ready = queue.feed(pdf["candidate_s"].dropna().tolist(), None if over or pd.isna(end) else float(end))
        if over:
            ready += queue.flush()
        state.update((json.dumps([queue.end, queue.waiting]),))
        yield pd.DataFrame({"stream_id": [key[0]] * len(ready), "candidate_s": ready})

    on_workers()
    kind = dict(rows.dtypes)["stream_id"]
    return rows.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, candidate_s double", "queue string", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet until its source has no more (availableNow)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
