"""Encoded frames: header decode as bit expressions, scans of binary streams, stream metadata blocks, codec detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import on_workers

#: Fixed values of the formats: kbit/s of layer III by bitrate index 1..14 (version 1; versions 2 and 2.5), sample rates by index (version 1, 2, 2.5), sample rates of ADTS.
KBPS_1 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBPS_2 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1)).cast("int")


def _pick(values: tuple[int, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def mp3_header(word: Column) -> Column:
    """struct(length, sample_rate, samples) of a four-byte header as a long; null if it isn't one of layer III with a known size."""
    version, layer, bitrate, rate, pad = _bits(word, 19, 2), _bits(word, 17, 2), _bits(word, 12, 4), _bits(word, 10, 2), _bits(word, 9, 1)
    good = (_bits(word, 21, 11) == 0x7FF) & (version != 1) & (layer == 1) & ~bitrate.isin(0, 15) & (rate != 3)
    first = version == 3
    kbps = F.when(first, _pick(KBPS_1, bitrate - 1)).otherwise(_pick(KBPS_2, bitrate - 1))
    hz = F.when(first, _pick(RATES[3], rate)).when(version == 2, _pick(RATES[2], rate)).otherwise(_pick(RATES[0], rate))
    length = (F.floor(F.when(first, 144000).otherwise(72000) * kbps / hz) + pad).cast("int")
    return F.when(good & (length > 4), F.struct(length.alias("length"), hz.alias("sample_rate"), F.when(first, 1152).otherwise(576).alias("samples")))


def adts_header(high: Column, low: Column) -> Column:
    """struct(length, sample_rate, samples) of a seven-byte header: its first four bytes and its last three, as longs."""
    rate, absent = _bits(high, 10, 4), _bits(high, 16, 1)
    length = (F.shiftleft(_bits(high, 0, 2), 11) + F.shiftrightunsigned(low, 13).bitwiseAND(F.lit(0x7FF))).cast("int")
    good = (_bits(high, 24, 8) == 0xFF) & (_bits(high, 16, 8).bitwiseAND(F.lit(0xF6)) == 0xF0) & (rate < 13)
    size = F.when(absent == 1, 7).otherwise(9)
    return F.when(good & (length >= size), F.struct(length.alias("length"), _pick(ADTS_RATES, rate).alias("sample_rate"), (1024 * (_bits(low, 0, 2) + 1)).alias("samples")))


def parse_mp3(data: bytes, at: int) -> tuple[int, int, int] | None:
    """length, sample_rate, samples of the header at a place in bytes, for scans."""
    if at + 4 > len(data):
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    version, layer, bitrate, rate = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer != 1 or bitrate in (0, 15) or rate == 3:
        return None
    first = version == 3
    hz = RATES[version][rate]
    length = (144000 if first else 72000) * (KBPS_1 if first else KBPS_2)[bitrate - 1] // hz + (word >> 9 & 1)
    return (length, hz, 1152 if first else 576) if length > 4 else None


def parse_adts(data: bytes, at: int) -> tuple[int, int, int] | None:
    if at + 7 > len(data):
        return None
    b = data[at : at + 7]
    rate, length = b[2] >> 2 & 15, (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5
    if b[0] != 0xFF or b[1] & 0xF6 != 0xF0 or rate > 12 or length < (7 if b[1] & 1 else 9):
        return None
    return length, ADTS_RATES[rate], 1024 * ((b[6] & 3) + 1)


HEADERS = {"mp3": (parse_mp3, 4), "aac": (parse_adts, 7)}


class FrameScan:
    """Frames of a byte stream that arrives in pieces: what is incomplete waits, junk is passed a byte at a time, time is the running sum of durations."""

    def __init__(self, codec: str, offset: int = 0, elapsed: float = 0.0, pending: bytes = b""):
        self.parse, self.header = HEADERS[codec]
        self.codec, self.offset, self.elapsed, self.pending = codec, offset, elapsed, pending

    def feed(self, piece: bytes) -> list[tuple[str, int, int, int, int, float]]:
        data, at, out = self.pending + piece, 0, []
        while at + self.header <= len(data):
            found = self.parse(data, at)
            if found is None:
                at += 1
                continue
            length, rate, samples = found
            if at + length > len(data):
                break
            out.append((self.codec, self.offset + at, length, rate, samples, self.elapsed))
            self.elapsed += samples / rate
            at += length
        self.pending = data[at:]
        self.offset += at
        return out


FRAME = "codec string, offset long, length int, sample_rate int, samples int, time_seconds double"


def frames(chunks: DataFrame, codec: str, by: str = "stream_id") -> DataFrame:
    """Frames of chunks(seq, data): each stream is read in order, a chunk at a time, so only the incomplete tail is held."""
    on_workers()
    key = dict(chunks.dtypes)[by]
    ordered = chunks.select(by, "seq", "data").repartition(by).sortWithinPartitions(by, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, stream = None, object()
        for pdf in batches:
            rows = []
            for k, data in zip(pdf[by], pdf["data"]):
                if k != stream:
                    scan, stream = FrameScan(codec), k
                rows += [(k, *f) for f in scan.feed(bytes(data))]
            yield pd.DataFrame(rows, columns=[by, "codec", "offset", "length", "sample_rate", "samples", "time_seconds"])

    return ordered.mapInPandas(run, f"{by} {key}, {FRAME}")


class Demux:
    """Audio and metadata blocks of an interleaved stream that arrives in pieces: `interval` bytes of audio, a length byte (times 16), a block."""

    def __init__(self, interval: int):
        if interval <= 0:
            raise ValueError("the metadata interval must be positive")
        self.interval, self.left, self.need, self.block, self.clean = interval, interval, None, b"", 0

    def feed(self, piece: bytes) -> tuple[bytes, list[tuple[str, int]]]:
        """The audio, and (title, offset in the audio) of each block with a title."""
        audio, events, at = [], [], 0
        while at < len(piece):
            if self.need is None and self.left:
                part = piece[at : at + self.left]
                audio.append(part)
                at += len(part)
                self.left -= len(part)
                self.clean += len(part)
            elif self.need is None:
                self.need, self.block = piece[at] * 16, b""
                at += 1
            if self.need is not None:
                part = piece[at : at + self.need - len(self.block)]
                self.block += part
                at += len(part)
                if len(self.block) == self.need:
                    if (title := block_title(self.block)) is not None:
                        events.append((title, self.clean))
                    self.need, self.left = None, self.interval
        return b"".join(audio), events


def block_title(block: bytes) -> str | None:
    raw = block.rstrip(b"\0")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("cp1252", "replace")
    _, found, rest = text.partition("StreamTitle='")
    title, end, _ = rest.partition("';")
    return (title.strip() or None) if found and end else None


def demuxed(chunks: DataFrame, interval: int, by: str = "stream_id") -> DataFrame:
    """by, seq, audio, events(title, audio_offset) for each chunk in order."""
    on_workers()
    key = dict(chunks.dtypes)[by]
    ordered = chunks.select(by, "seq", "data").repartition(by).sortWithinPartitions(by, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        demux, stream = None, object()
        for pdf in batches:
            rows = []
            for k, seq, data in zip(pdf[by], pdf["seq"], pdf["data"]):
                if k != stream:
                    demux, stream = Demux(interval), k
                audio, events = demux.feed(bytes(data))
                rows.append((k, seq, audio, [{"title": t, "audio_offset": o} for t, o in events]))
            yield pd.DataFrame(rows, columns=[by, "seq", "audio", "events"])

    return ordered.mapInPandas(run, f"{by} {key}, seq long, audio binary, events array<struct<title: string, audio_offset: long>>")


def detected_codec(frames_: DataFrame, least: int = 3, by: str = "stream_id") -> DataFrame:
    """by, codec: the only codec with a run of `least` byte-contiguous frames of one rate; null if none or both have one."""
    w = Window.partitionBy(by, "codec").orderBy("offset")
    joined = (F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset")) & (F.lag("sample_rate").over(w) == F.col("sample_rate"))
    x = frames_.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = x.groupBy(by, "codec", "run").agg(F.count(F.lit(1)).alias("n"))
    ok = runs.groupBy(by, "codec").agg((F.max("n") >= least).alias("ok"))
    return ok.groupBy(by).agg(F.count(F.when(F.col("ok"), 1)).alias("n"), F.max(F.when(F.col("ok"), F.col("codec"))).alias("codec")).select(by, F.when(F.col("n") == 1, F.col("codec")).alias("codec"))
