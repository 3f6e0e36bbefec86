"""What a user may put in place of the engine's own parts. All are functions from DataFrames to DataFrames, or objects with the methods named."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class BoundaryProvider(Protocol):
    """ends(stream_id, first_s, last_end_s) -> candidates(stream_id, k, candidate_s)."""

    def __call__(self, ends: DataFrame) -> DataFrame: ...


@runtime_checkable
class CandidateResolver(Protocol):
    """levels, frames, candidates -> resolutions: kind, incoming_start_s, outgoing_end_s, split_kind, incoming_offset, outgoing_offset. Candidates that it abstains on have no row."""

    def __call__(self, levels: DataFrame, frames: DataFrame, candidates: DataFrame) -> DataFrame: ...


@runtime_checkable
class EvidenceDetector(Protocol):
    """pcm(stream_id, data) or levels -> proposals(stream_id, time_s, source, depth, strength, start_s, recovery_s)."""

    def __call__(self, signal: DataFrame) -> DataFrame: ...


@runtime_checkable
class Analyzer(Protocol):
    """signal, boundaries(stream_id, k, time_s) -> one row for each boundary with whole context; before_s and after_s say how much that is, available whether it can run at all."""

    before_s: float
    after_s: float
    available: bool

    def __call__(self, signal: DataFrame, boundaries: DataFrame) -> DataFrame: ...


class SpectralAnalyzer(Analyzer, Protocol):
    """between, and sequential variability and spread of either side."""


class TemporalAnalyzer(Analyzer, Protocol):
    """ratio_8, ratio_16, ratio_24, ratio_40."""


class LocalAnalyzer(Analyzer, Protocol):
    """d250, d500, d1, d2."""


@runtime_checkable
class Evaluator(Protocol):
    """A column over evidence: a confidence, or a label."""

    def __call__(self, evidence: DataFrame) -> Column: ...


@runtime_checkable
class Router(Protocol):
    """contexts -> contexts with kind."""

    def __call__(self, contexts: DataFrame) -> DataFrame: ...


@runtime_checkable
class Specialist(Protocol):
    """A column over routed contexts: struct(kind, incoming_start_s, outgoing_end_s), null where it abstains."""

    def __call__(self, contexts: DataFrame) -> Column: ...


@runtime_checkable
class CandidateBuilder(Protocol):
    """references(stream_id, k, reference_s) -> ranked candidates."""

    def __call__(self, references: DataFrame) -> DataFrame: ...


@runtime_checkable
class CandidateSelector(Protocol):
    """ranked candidates -> one of each reference."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


@runtime_checkable
class SplitAligner(Protocol):
    """decisions, frames -> decisions with split_kind, incoming_offset, outgoing_offset."""

    def __call__(self, decisions: DataFrame, frames: DataFrame) -> DataFrame: ...


@runtime_checkable
class EncodedBytes(Protocol):
    """Bytes that can be read by range while they are retained."""

    end_offset: int

    def contains(self, start: int, end: int) -> bool: ...

    def read(self, start: int, end: int) -> Iterable[bytes]: ...


@runtime_checkable
class Ingestor(Protocol):
    """What chunks of a stream are fed to: it gives the frames that they complete."""

    def feed(self, piece: bytes) -> Iterator | list: ...


PROVIDERS: dict[str, BoundaryProvider] = {}
RESOLVERS: dict[str, CandidateResolver] = {}


def register_provider(name: str, provider: BoundaryProvider) -> None:
    """Let api.segment() take candidates from a provider by this name."""
    _register(PROVIDERS, name, provider)


def register_resolver(name: str, resolver: CandidateResolver) -> None:
    _register(RESOLVERS, name, resolver)


def _register(table: dict, name: str, part) -> None:
    if not callable(part):
        raise TypeError("a part must be callable")
    if name in table or name in ("fixed", "manual", "external", "default", "hybrid"):
        raise ValueError(f"the name is taken: {name!r}")
    table[name] = part
