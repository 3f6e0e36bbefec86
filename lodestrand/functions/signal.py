"""Signal kernels over NumPy arrays: spectra, cepstra, chroma, band energies, directed novelty. Constants are built once a worker."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed values of the feature definitions: transform size, frame and hop in seconds, mel range and count, cepstral coefficients kept, chroma range, bands of the envelope features.
N_FFT = 512
FRAME_S, HOP_S = 0.025, 0.010
MEL_LOW, MEL_HIGH, MELS, CEPSTRA = 40.0, 7600.0, 40, 12
CHROMA_LOW, CHROMA_HIGH = 55.0, 5000.0
BAND_FRAME_S, BAND_HOP_S, BANDS, BAND_LOW, BAND_HIGH = 0.050, 0.025, 8, 40.0, 8000.0
NOVELTY_FRAME, NOVELTY_HOP, NOVELTY_LOW, NOVELTY_HIGH = 512, 128, 80.0, 3800.0
TINY = 1e-12


def from_pcm(data: bytes) -> np.ndarray:
    """Signed 16-bit little-endian samples as floats in [-1, 1); an odd last byte is dropped."""
    return np.frombuffer(data, "<i2", len(data) // 2) / 32768.0


def power(signal: np.ndarray, size: int, hop: int, n_fft: int | None = None) -> np.ndarray:
    """Power spectra of Hann-windowed frames, one row a frame; a signal shorter than a frame is padded to one."""
    if len(signal) < size:
        signal = np.pad(signal, (0, size - len(signal)))
    framed = np.lib.stride_tricks.sliding_window_view(signal, size)[::hop] * np.hanning(size)
    return np.abs(np.fft.rfft(framed, n_fft or size, axis=1)) ** 2


def mel(hz):
    return 2595.0 * np.log10(1.0 + np.asarray(hz) / 700.0)


def from_mel(m):
    return 700.0 * (10.0 ** (np.asarray(m) / 2595.0) - 1.0)


@functools.lru_cache(maxsize=8)
def mel_bank(rate: int) -> np.ndarray:
    """Triangles over the transform's frequencies, one row a mel band: the lower of a rising and a falling line."""
    f = np.fft.rfftfreq(N_FFT, 1 / rate)
    edges = from_mel(np.linspace(mel(MEL_LOW), mel(min(rate / 2, MEL_HIGH)), MELS + 2))
    left, top, right = (edges[i : i + MELS, None] for i in range(3))
    return np.clip(np.minimum((f - left) / (top - left), (right - f) / (right - top)), 0, None)


@functools.lru_cache(maxsize=2)
def cosines() -> np.ndarray:
    """Orthonormal DCT-II without its first row."""
    k, n = np.arange(1, CEPSTRA + 1)[:, None], np.arange(MELS)
    return np.sqrt(2 / MELS) * np.cos(np.pi / MELS * (n + 0.5) * k)


@functools.lru_cache(maxsize=8)
def pitch_classes(rate: int) -> np.ndarray:
    """One column a pitch class (C is 0): which frequencies belong to it."""
    f = np.fft.rfftfreq(N_FFT, 1 / rate)
    inside = (f >= CHROMA_LOW) & (f <= min(rate / 2, CHROMA_HIGH))
    note = np.rint(69 + 12 * np.log2(np.where(inside, f, 440) / 440)).astype(int) % 12
    return (note[:, None] == np.arange(12)) & inside[:, None]


def block_vector(signal: np.ndarray, rate: int) -> np.ndarray:
    """log RMS, the medians of 12 cepstral coefficients, and the median chroma of unit length: 25 numbers."""
    level = np.log(np.sqrt(np.mean(signal**2) + TINY) + TINY) if len(signal) else np.log(TINY)
    spectrum = power(signal, round(rate * FRAME_S), round(rate * HOP_S), N_FFT)
    cepstra = np.median(np.log(np.maximum(spectrum @ mel_bank(rate).T, TINY)) @ cosines().T, axis=0)
    chroma = spectrum @ pitch_classes(rate)
    chroma = np.median(chroma / np.maximum(chroma.sum(axis=1, keepdims=True), TINY), axis=0)
    length = np.linalg.norm(chroma)
    return np.concatenate(([level], cepstra, chroma / length if length > TINY else chroma))


def profile(signal: np.ndarray, rate: int, size: int = 2048) -> np.ndarray:
    """Medians over half-overlapping frames of centroid, spread, entropy, flatness and 85 % roll-off, by their textbook definitions."""
    spectrum = power(signal, size, size // 2)
    f = np.fft.rfftfreq(size, 1 / rate)
    share = spectrum / np.maximum(spectrum.sum(axis=1, keepdims=True), TINY)
    centroid = share @ f
    spread = np.sqrt(np.maximum(share @ f**2 - centroid**2, 0))
    entropy = -(share * np.log2(np.maximum(share, TINY))).sum(axis=1) / np.log2(len(f))
    flatness = np.exp(np.log(np.maximum(spectrum, TINY)).mean(axis=1)) / np.maximum(spectrum.mean(axis=1), TINY)
    rolloff = f[np.minimum((np.cumsum(share, axis=1) < 0.85).sum(axis=1), len(f) - 1)]
    return np.median(np.stack([centroid, spread, entropy, flatness, rolloff]), axis=1)


def band_frames(signal: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """RMS of each short frame, and the shares of its power below, in, and above geometric bands."""
    size, hop = round(rate * BAND_FRAME_S), round(rate * BAND_HOP_S)
    if len(signal) < size:
        return np.zeros(0), np.zeros((0, BANDS + 2))
    level = np.sqrt(np.mean(np.lib.stride_tricks.sliding_window_view(signal, size)[::hop] ** 2, axis=1))
    f = np.fft.rfftfreq(size, 1 / rate)
    edges = np.geomspace(BAND_LOW, min(BAND_HIGH, rate / 2), BANDS + 1)
    of = np.searchsorted(edges, f, side="right")
    bands = power(signal, size, hop) @ (of[:, None] == np.arange(BANDS + 2))
    return level, bands / np.maximum(bands.sum(axis=1, keepdims=True), 1e-18)


def novelty_frames(signal: np.ndarray, rate: int) -> np.ndarray:
    """Unit vectors of log power between two frequencies."""
    f = np.fft.rfftfreq(NOVELTY_FRAME, 1 / rate)
    v = np.log1p(power(signal, NOVELTY_FRAME, NOVELTY_HOP)[:, (f >= NOVELTY_LOW) & (f <= NOVELTY_HIGH)])
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), TINY)


def directed_novelty(before: np.ndarray, after: np.ndarray, rate: int) -> float:
    """How badly, in the mean, the best frame before explains a frame after."""
    return float(np.mean(1 - (novelty_frames(after, rate) @ novelty_frames(before, rate).T).max(axis=1)))
