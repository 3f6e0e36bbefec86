"""Bytes that arrive while a job runs: HTTP streams with interleaved titles, FIFOs, standard input, boundary lines; and what their headers say."""

from __future__ import annotations

import asyncio
import json
import os
import sys
import threading
import urllib.parse
import urllib.request
from collections.abc import AsyncIterator, Iterator, Mapping
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .framing import FrameScan

PROBE_BYTES, PROBE_STEP = 128 << 10, 4 << 10
RUN = 3


class ByteSource:
    """read(n) up to n bytes, empty at the end; metadata about them; close(), which standard input outlives."""

    def __init__(self, stream: BinaryIO, metadata: Mapping[str, str] | None = None, owned: bool = True):
        self.stream, self.metadata, self.owned = stream, dict(metadata or {}), owned

    @classmethod
    def stdin(cls) -> ByteSource:
        return cls(sys.stdin.buffer, owned=False)

    def read(self, n: int) -> bytes:
        return self.stream.read(n)

    def chunks(self, size: int = 65536) -> Iterator[bytes]:
        """Pieces until the end; the source is closed then, or when the reader stops."""
        if size <= 0:
            raise ValueError("the chunk size must be positive")
        try:
            while piece := self.read(size):
                yield piece
        finally:
            self.close()

    def close(self) -> None:
        if self.owned:
            self.stream.close()


def open_url(url: str, timeout: float = 20.0) -> ByteSource:
    """An HTTP stream that is asked for titles; its metadata are the headers, in lower case."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError("the url must be http or https")
    answer = urllib.request.urlopen(urllib.request.Request(url, headers={"Icy-MetaData": "1"}), timeout=timeout)
    return ByteSource(answer, {k.lower(): v for k, v in answer.headers.items()})


def metadata_interval(headers: Mapping[str, str]) -> int:
    """The bytes of audio between titles: header icy-metaint, an integer above 0."""
    text = {k.lower(): v for k, v in headers.items()}.get("icy-metaint")
    try:
        n = int(text)
    except (TypeError, ValueError):
        n = 0
    if n <= 0:
        raise ValueError(f"icy-metaint must be an integer above 0, not {text!r}")
    return n


def codec_of(audio: bytes) -> str | None:
    """The only codec with a run of contiguous frames of one rate; null if none or both have one."""
    found = []
    for codec in ("mp3", "aac"):
        run, end, rate = 0, None, None
        for _, offset, length, sample_rate, _, _ in FrameScan(codec).feed(audio):
            run = run + 1 if (offset, sample_rate) == (end, rate) else 1
            end, rate = offset + length, sample_rate
            if run >= RUN:
                found.append(codec)
                break
    return found[0] if len(found) == 1 else None


def probe(source: ByteSource, most: int = PROBE_BYTES, step: int = PROBE_STEP) -> tuple[str | None, list[bytes]]:
    """The codec, as soon as the head of the source tells, and the pieces that were read, to be fed again."""
    pieces: list[bytes] = []
    while sum(map(len, pieces)) < most and (piece := source.read(step)):
        pieces.append(piece)
        if codec := codec_of(b"".join(pieces)):
            return codec, pieces
    return None, pieces


def open_fifo(path: str) -> ByteSource:
    """A named pipe, opened in a thread of its own, as opening waits for a writer."""
    opened: list[BinaryIO] = []
    thread = threading.Thread(target=lambda: opened.append(os.fdopen(os.open(path, os.O_RDONLY), "rb", buffering=0)), daemon=True)
    thread.start()
    thread.join()
    return ByteSource(opened[0])


async def audio_chunks(reader: asyncio.StreamReader, size: int = 65536) -> AsyncIterator[bytes]:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    while piece := await reader.read(size):
        yield piece


def boundary(line: str, number: int) -> dict | None:
    """A record of one line of JSON, null for a blank one; errors name the line."""
    if not line.strip():
        return None
    try:
        record = json.loads(line)
    except ValueError as e:
        raise ValueError(f"line {number}: no JSON") from e
    time = record.get("time_seconds") if isinstance(record, dict) else None
    if isinstance(time, bool) or not isinstance(time, (int, float)):
        raise ValueError(f"line {number}: time_seconds must be a number")
    source, reference = record.get("source", "external"), record.get("reference_offset")
    if not isinstance(source, str) or isinstance(reference, bool) or not (reference is None or isinstance(reference, int)):
        raise ValueError(f"line {number}: source must be a string, reference_offset an integer or null")
    return {"time_seconds": float(time), "source": source, "reference_offset": reference}


async def boundaries(reader: asyncio.StreamReader) -> AsyncIterator[dict]:
    number = 0
    while line := await reader.readline():
        number += 1
        if (record := boundary(line.decode(), number)) is not None:
            yield record


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are numbers of chunks; what was read stays in memory until it is committed."""

    def __init__(self, options: Mapping[str, str]):
        self.source, self.size = open_url(options["url"]), int(options.get("chunk", PROBE_STEP))
        self.many, self.held = int(options.get("batch", 16)), {}

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["chunk"]
        rows = []
        while len(rows) < self.many and (data := self.source.read(self.size)):
            rows.append((0, n + len(rows), data))
        self.held |= {r[1]: r for r in rows}
        return iter(rows), {"chunk": n + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.held[i] for i in range(start["chunk"], end["chunk"])])

    def commit(self, end: dict) -> None:
        self.held = {i: r for i, r in self.held.items() if i >= end["chunk"]}


class HttpChunks(DataSource):
    """spark.readStream.format("http_chunks").option("url", ...): stream_id, seq, data. Register it with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "http_chunks"

    def schema(self) -> str:
        return "stream_id long, seq long, data binary"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


__all__ = ["ByteSource", "HttpChunks", "audio_chunks", "boundaries", "boundary", "codec_of", "metadata_interval", "open_fifo", "open_url", "probe"]
