"""Segments as files: names that overwrite nothing, files that are whole or absent, receipts, and what a crash leaves.

A file is written under a private name in `.recovery`, synced, and linked to its own name; the link fails if the name is
taken, and the next of -2, -3 ... is tried. Two names of one file are a publication whose end wasn't recorded: reconcile()
drops the private one. A private file without a second name was never published, and stays for inspection.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import on_workers
from .operators import output, spans
from .shared import checkpoint

RECOVERY = ".recovery"
NAME_BYTES = 240


def _synced(folder: str) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def shortened(stem: str, extension: str, suffix: str = "", most: int = NAME_BYTES) -> str:
    """stem + suffix + extension in at most `most` bytes; the stem is cut between characters."""
    room = most - len((suffix + extension).encode())
    return stem.encode()[: max(0, room)].decode("utf-8", "ignore") + suffix + extension


def publish(folder: str, stem: str, extension: str, pieces: Iterable[bytes]) -> dict:
    """Write pieces to a new file in folder, under the first name that is free. Gives path, n_bytes."""
    private = os.path.join(folder, RECOVERY)
    os.makedirs(private, mode=0o700, exist_ok=True)
    hidden, n = os.path.join(private, uuid.uuid4().hex), 0
    with open(hidden, "xb") as out:
        for piece in pieces:
            out.write(piece)
            n += len(piece)
        out.flush()
        os.fsync(out.fileno())
    for i in range(1, 1 << 30):
        path = os.path.join(folder, shortened(stem, extension, f"-{i}" if i > 1 else ""))
        try:
            os.link(hidden, path)
            break
        except FileExistsError:
            continue
    _synced(folder)
    os.unlink(hidden)
    _synced(private)
    return {"path": path, "n_bytes": n}


def reconcile(folder: str) -> tuple[list[str], list[str]]:
    """Private names of published files go; those never published stay: (removed, retained)."""
    private = os.path.join(folder, RECOVERY)
    removed, retained = [], []
    for name in sorted(os.listdir(private)) if os.path.isdir(private) else []:
        path = os.path.join(private, name)
        if os.stat(path).st_nlink > 1:
            os.unlink(path)
            removed.append(name)
        else:
            retained.append(name)
    if removed:
        _synced(private)
    return removed, retained


def write_ranges(chunks: DataFrame, files: DataFrame, folder: str, extension: str, piece: int = 1 << 20, size: int = spans.CHUNK) -> DataFrame:
    """Write files(stream_id, range, start_offset, end_offset, stem) as files in folder, which all machines share: stream_id, range, path, n_bytes.

    Pieces of a file arrive in order in one task, which holds one at a time. A file of which a piece isn't retained isn't
    written: its path is null. The result is checkpointed, so reading it again writes nothing.
    """
    on_workers()
    ranges = files.select("stream_id", "range", "start_offset", "end_offset")
    found = spans.read(chunks, ranges, piece, size).join(files.select("stream_id", "range", "stem"), ["stream_id", "range"])
    whole = found.groupBy("stream_id", "range").agg((F.count(F.when(F.col("data").isNull(), 1)) == 0).alias("whole"))
    rows = found.join(whole, ["stream_id", "range"]).select("stream_id", "range", "stem", "whole", "piece", F.when(F.col("whole"), F.col("data")).alias("data"))
    rows = rows.repartition("stream_id", "range").sortWithinPartitions("stream_id", "range", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(batch.column(j)[i].as_py() for j in (0, 1, 2, 3, 5))

        row, source = None, pieces()
        row = next(source, None)
        while row is not None:
            key, stem, complete = row[:2], row[2], row[3]

            def own():
                nonlocal row
                while row is not None and row[:2] == key:
                    yield row[4] or b""
                    row = next(source, None)

            if complete:
                receipt = publish(folder, stem, extension, own())
            else:
                receipt = {"path": None, "n_bytes": sum(map(len, own()))}
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], types[0]), pa.array([key[1]], types[1]), pa.array([receipt["path"]], pa.string()), pa.array([receipt["n_bytes"]], pa.int64())], ["stream_id", "range", "path", "n_bytes"])

    from pyspark.sql.pandas.types import to_arrow_schema

    head = rows.select("stream_id", "range").schema
    types = [f.type for f in to_arrow_schema(head)]
    return checkpoint(rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", path string, n_bytes long"))


def write_session(chunks: DataFrame, splits: DataFrame, folder: str, extension: str, size: int = spans.CHUNK) -> tuple[DataFrame, DataFrame]:
    """Write what each of splits(stream_id, n, title, previous_start, next_end, incoming_offset, outgoing_offset, split_kind) ends, and what neither side owns: receipts by role, and the ledger of their ranges."""
    planned = output.planned(splits, crossfade_unowned=True).where("role <> 'incoming'")
    number = (F.col("n") * 2 + (F.col("role") == "unowned").cast("int")).cast("long")
    files = planned.select("stream_id", number.alias("range"), "start_offset", "end_offset", F.when(F.col("role") == "unowned", F.format_string("unowned_%d_%d", "stream_id", "n")).otherwise(F.col("title")).alias("stem"), "role")
    files = checkpoint(files)
    receipts = write_ranges(chunks, files, folder, extension, size=size).join(files.select("stream_id", "range", "role", "start_offset", "end_offset"), ["stream_id", "range"])
    return receipts, output.ledger(receipts.where("path is not null").withColumn("seq", F.col("range")))


def write_terminal(chunks: DataFrame, tails: DataFrame, folder: str, size: int = spans.CHUNK) -> DataFrame:
    """Write the tails(stream_id, status, tail_start, tail_end) of spans.finalized as .bin files that no track owns."""
    files = tails.where("status = 'TAIL'").select("stream_id", F.lit(0).cast("long").alias("range"), F.col("tail_start").alias("start_offset"), F.col("tail_end").alias("end_offset"), F.format_string("tail_%s", F.col("stream_id").cast("string")).alias("stem"))
    return write_ranges(chunks, files, folder, ".bin", size=size)


def write_provenance(folder: str, session: str, receipts: list[dict], covered_end: int, tail: tuple[int, int] | None) -> dict:
    """One record of all that a session published, by start, with sorted keys, as a file of its own."""
    if len(session) != 32 or set(session) - set("0123456789abcdef"):
        raise ValueError("a session is named by 32 hexadecimal digits")
    ranges = sorted(receipts, key=lambda r: (r["start"], r["end"]))
    record = {"session": session, "ranges": ranges, "covered_end": covered_end, "tail": None if tail is None else {"start": tail[0], "end": tail[1]}}
    return publish(folder, f"session-{session}", ".json", [json.dumps(record, sort_keys=True).encode()])


class Sink:
    """Segments of one growing stream, written as their ends become known: accept() writes up to an outgoing edge and goes on from the incoming one; finalize() writes the rest, once."""

    def __init__(self, folder: str, extension: str, read, start: int = 0, discard=None):
        self.folder, self.extension, self.read, self.start, self.discard = folder, extension, read, start, discard
        self.index, self.done = 1, False

    def accept(self, outgoing: int, incoming: int) -> dict:
        if self.done:
            raise ValueError("the sink is finalized")
        receipt = self._write(outgoing)
        self.start = incoming
        if self.discard:
            self.discard(incoming)
        return receipt

    def finalize(self, end: int) -> dict | None:
        if self.done:
            return None
        self.done = True
        return self._write(end) if end > self.start else None

    def _write(self, end: int) -> dict:
        if end <= self.start:
            raise ValueError("a segment must end after it starts")
        receipt = publish(self.folder, f"segment_{self.index:04d}", self.extension, self.read(self.start, end))
        self.index += 1
        return receipt | {"index": self.index - 1, "start_offset": self.start, "end_offset": end}
