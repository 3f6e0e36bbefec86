"""A session over one stream of interleaved audio and titles: tracks, the transitions between them, and when each can be resolved.

Session is the state machine; `sessions` runs one for each stream of a streaming table, its state in the operator's store.
"""

from __future__ import annotations

import asyncio
import json
from collections.abc import AsyncIterator, Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrand import on_workers
from lodestrand.sources.framing import Demux, FrameScan

from .ingest import SettleQueue, TitleTracker, _in_order


@dataclass
class Session:
    """Feed it titles and the stream's end, in this order for each step: titles close and confirm tracks; the end confirms the open one; then tracks at the head of the queue are resolved.

    boundary(title, start): the time at which a track's audio begins, null while it can't be told. A head waits until the
    stream is `settle` seconds past it, or another track follows; one that can't be resolved stays, and those behind it wait.
    A short title that `excluded` names is left out, if the next track starts where it ends.
    """

    threshold: float
    settle: float
    boundary: Callable[[str, float], float | None] = lambda title, start: start
    excluded: Callable[[str, float], bool] = lambda title, lifetime: False
    tracker: TitleTracker = None
    end: float = 0.0
    current: tuple[str, float] | None = None
    waiting: list[tuple[str, float]] = field(default_factory=list)
    left_out: tuple[float, float] | None = None

    def __post_init__(self):
        self.tracker = self.tracker or TitleTracker(self.threshold)

    def feed(self, titles: list[tuple[str, float]], end: float | None = None) -> list[tuple]:
        """(outgoing title, incoming title, kind, incoming_start_s, outgoing_end_s) of each transition that is resolved now."""
        self.end = max(self.end, end or 0.0)
        for title, t in titles:
            for what, name, start, at in self.tracker.feed(title, t):
                if what == "NO_BOUNDARY" and self.excluded(name, at - start):
                    self.left_out = (start, at)
                if what == "TRACK":
                    self.waiting.append((name, start))
        for _, name, start, _ in self.tracker.clock(self.end):
            self.waiting.append((name, start))
        return self.resolved()

    def resolved(self, final: bool = False) -> list[tuple]:
        out = []
        while self.waiting:
            title, start = self.waiting[0]
            if self.current is None:  # the first track only opens the session
                self.current = self.waiting.pop(0)
                continue
            if not (final or len(self.waiting) > 1 or self.end >= start + self.settle):
                break
            gap, self.left_out = self.left_out, None
            if gap is not None and abs(gap[1] - start) <= 1e-6:
                decision = ("EXCLUSION", start, gap[0])
            elif (t := self.boundary(title, start)) is not None:
                decision = ("HARD_CUT", t, t)
            else:
                break
            out.append((self.current[0], title, *decision))
            self.current = self.waiting.pop(0)
        return out

    def finish(self) -> list[tuple]:
        return self.resolved(final=True)

    def state(self) -> str:
        t = self.tracker
        return json.dumps([t.title, t.start, t.confirmed, self.end, self.current, self.waiting, self.left_out])

    def restore(self, state: str) -> Session:
        t = self.tracker
        t.title, t.start, t.confirmed, self.end, current, waiting, left_out = json.loads(state)
        self.current, self.left_out = (tuple(x) if x else None for x in (current, left_out))
        self.waiting = [tuple(x) for x in waiting]
        return self


TRANSITION = "outgoing string, incoming string, kind string, incoming_start_s double, outgoing_end_s double"


def sessions(events: DataFrame, threshold: float, settle: float, boundary=None, excluded=None) -> DataFrame:
    """Transitions of streaming events(stream_id, seq, title or null, t): an event without a title says how far the stream has come; one at infinity ends it."""
    given = {k: v for k, v in (("boundary", boundary), ("excluded", excluded)) if v}

    def step(key, pdfs, state: GroupState):
        session = Session(threshold, settle, **given)
        if state.exists:
            session.restore(state.get[0])
        rows = []
        for title, t in _in_order(pdfs)[["title", "t"]].itertuples(index=False):
            if t == float("inf"):
                rows += session.finish()
            else:
                rows += session.feed([] if title is None else [(title, float(t))], float(t))
        state.update((session.state(),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["stream_id", *(f.split(" ")[0] for f in TRANSITION.split(", "))])

    on_workers()
    kind = dict(events.dtypes)["stream_id"]
    return events.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, {TRANSITION}", "session string", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Runner:
    """One growing stream in this process: bytes in, candidates asked for up to the new end, those that have settled resolved.

    propose(from, to): candidates in (from, to]. resolve(t, frames): (outgoing offset, incoming offset), or null.
    """

    codec: str
    settle: float
    propose: Callable[[float, float], list[float]]
    resolve: Callable[[float, list], tuple[int, int] | None]
    scan: FrameScan = None
    frames: list = field(default_factory=list)
    end: float = 0.0
    queue: SettleQueue = None

    def __post_init__(self):
        self.scan, self.queue = self.scan or FrameScan(self.codec), self.queue or SettleQueue(self.settle)

    def feed(self, piece: bytes) -> list[tuple[float, tuple[int, int] | None]]:
        self.frames += self.scan.feed(piece)
        return self._step([])

    def submit(self, t: float) -> list[tuple[float, tuple[int, int] | None]]:
        """A candidate from elsewhere, at any time; a late one is resolved at once."""
        return self._step([t])

    def finish(self) -> list[tuple[float, tuple[int, int] | None]]:
        return self._resolved(self.queue.flush())

    def _step(self, extra: list[float]) -> list:
        end = self.frames[-1][5] + self.frames[-1][4] / self.frames[-1][3] if self.frames else None
        proposed = []
        if end is not None:
            if end < self.end:
                raise ValueError("a stream doesn't go back")
            proposed, self.end = self.propose(self.end, end), end
        return self._resolved(self.queue.feed(proposed + extra, end))

    def _resolved(self, ready: list[float]) -> list:
        return [(t, self.resolve(t, self.frames)) for t in ready]


async def multiplexed(runner: Runner, audio: AsyncIterator[bytes], boundaries: AsyncIterator[float], on_resolved: Callable[[tuple], None]) -> list[float]:
    """Feed a runner from two producers through one queue, so that it is only met by one at a time. What hasn't settled at the end is given back."""
    queue: asyncio.Queue = asyncio.Queue(maxsize=64)

    async def produce(items: AsyncIterator, kind: str) -> None:
        async for item in items:
            await queue.put((kind, item))
        await queue.put(("done", kind))

    producers = [asyncio.create_task(produce(items, kind)) for items, kind in ((audio, "audio"), (boundaries, "boundary"))]
    left = len(producers)
    try:
        while left:
            kind, item = await queue.get()
            left -= kind == "done"
            for result in runner.feed(item) if kind == "audio" else runner.submit(item) if kind == "boundary" else []:
                on_resolved(result)
        for p in producers:
            await p
    finally:
        for p in producers:
            p.cancel()
    return list(runner.queue.waiting)


def demultiplexed(interval: int, codec: str) -> Callable[[bytes], tuple[bytes, list[tuple[str, float | None]], float | None]]:
    """A function of pieces: their audio, titles with the time of the frame that ends after each (null: not yet told), and the end so far."""
    demux, scan, frames, open_ = Demux(interval), FrameScan(codec), [], []

    def feed(piece: bytes) -> tuple[bytes, list[tuple[str, float | None]], float | None]:
        audio, events = demux.feed(piece)
        frames.extend(scan.feed(audio))
        open_.extend(events)
        timed = []
        while open_ and (hit := next((f for f in frames if f[1] + f[2] > open_[0][1]), None)):
            timed.append((open_.pop(0)[0], hit[5]))
        return audio, timed, frames[-1][5] + frames[-1][4] / frames[-1][3] if frames else None

    return feed
