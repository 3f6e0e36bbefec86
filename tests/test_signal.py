"""Signal kernels against what tones and noise must give."""

import numpy as np
import pytest

from lodestrand.functions import signal as K
from lodestrand.operators import spectral as S

RATE = 8000


def tone(hz, seconds=1.0, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(round(RATE * seconds)) / RATE)


def pcm(signal):
    return (signal * 32767).astype("<i2").tobytes()


def test_constants():
    assert np.allclose(K.cosines() @ K.cosines().T, np.eye(K.CEPSTRA))
    bank = K.mel_bank(RATE)
    assert bank.shape == (K.MELS, K.N_FFT // 2 + 1) and bank.min() >= 0 and bank.max() <= 1
    assert K.from_mel(K.mel(1234.5)) == pytest.approx(1234.5)
    assert K.pitch_classes(RATE).sum(axis=1).max() == 1


def test_block_vector_of_a_tone():
    v = K.block_vector(tone(1760), RATE)
    assert v[0] == pytest.approx(np.log(0.5 / np.sqrt(2)), abs=0.01)
    assert v[13:].argmax() == 9 and np.linalg.norm(v[13:]) == pytest.approx(1)
    assert len(K.block_vector(np.zeros(0), RATE)) == 25


def test_profile_of_a_tone_and_of_noise():
    a, b = K.profile(tone(1000), RATE), K.profile(np.random.default_rng(1).normal(0, 0.1, RATE), RATE)
    assert a[0] == pytest.approx(1000, abs=5) and a[1] < 50 and a[3] < 0.01
    assert b[0] == pytest.approx(2000, abs=100) and b[2] > 0.85 and b[3] > 0.4


def test_bands_and_novelty():
    level, bands = K.band_frames(tone(100), RATE)
    assert np.allclose(bands.sum(axis=1), 1) and level.mean() == pytest.approx(0.5 / np.sqrt(2), abs=0.01)
    assert K.directed_novelty(tone(300), tone(300), RATE) < 0.05 < 0.3 < K.directed_novelty(tone(300), tone(2500), RATE)


def test_edges_peak_at_the_change(spark):
    signal = np.concatenate([tone(200, 1.0, 0.05), tone(1500, 1.0, 0.5)])
    rows = spark.createDataFrame([(1, bytearray(pcm(signal))), (2, bytearray(b"")), (3, None)], "stream_id long, data binary")
    out = S.edge_evidence(S.band_features(rows, RATE), (0.25,)).toPandas()
    best = out.loc[out.energy.idxmax()]
    assert set(out.stream_id) == {1} and abs(best.idx * K.BAND_HOP_S - 1.0) <= 0.06 and best.spectral > 0.9
    assert [r.idx for r in S.block_vectors(rows, RATE, 0.5).orderBy("idx").collect()] == [0, 1, 2, 3]
    assert S.profiles(rows, RATE, 0.5).count() == 4
    novelty = S.novelties(rows, RATE, 0.5, 0.25).toPandas()
    assert novelty.loc[novelty.novelty.idxmax()].time_s == 1.0
