"""Whole texts, and all labelled rows, count."""

import random

import numpy as np
import pytest

from lodestrand.llm import quality, toxicity
from lodestrand.llm.queries import good_documents, good_ids


def test_pieces_cover_long_words():
    r = random.Random(5)
    texts = ["".join(r.choice("abé語 ,") for _ in range(r.randrange(80))) + r.choice(["", " "]) + "".join(r.choice("xyz字") for _ in range(r.choice([0, 9, 300]))) for _ in range(200)]
    texts += ["", "a" * 16, "a" * 17, "語" * 50, "z" * 5000]
    encoded = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])
    words = toxicity.words_of(data, offsets, toxicity.BLANK)
    starts, ends, first = toxicity.pieces(data, *words)
    assert (ends > starts).all() and (ends - starts).max() <= toxicity.LETTERS
    covered = lambda s, e: np.concatenate([np.arange(a, z) for a, z in zip(s, e)])
    assert (covered(starts, ends) == covered(*words[:2])).all()
    for i in range(len(texts)):
        assert all(offsets[i] <= a and z <= offsets[i + 1] for a, z in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]))
    short = words[1] - words[0] <= toxicity.LETTERS
    assert set(zip(words[0][short], words[1][short])) <= set(zip(starts, ends))


def test_toxicity_reads_long_words_whole(spark):
    """Texts that are one run of characters beyond ASCII: what marks them stands far behind the run's first letters."""
    r = random.Random(6)
    plain, bad = [chr(0x4E00 + i) for i in range(300)], ["愚蠢至極", "混帳東西", "滾出去吧"]
    rows, labels = [], []
    for i in range(900):
        chars = [r.choice(plain) for _ in range(80)]
        if i % 3 == 0:
            for _ in range(4):
                chars[r.randrange(20, 80)] = r.choice(bad)
        rows.append((i, "".join(chars)))
        labels.append((i, int(i % 3 == 0)))
    out = toxicity.predictions(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [p for p in out if p.held_out]
    assert len(held) > 200 and sum(p.predicted == int(p.doc_id % 3 == 0) for p in held) / len(held) > 0.95


def test_all_good_documents_count(spark, tmp_path):
    """Each labelled row of 9,000 counts in the bands' limits: they are the quantiles of all."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    texts = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(9000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in texts] + [(1, 1), (9999, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    good = good_documents(spark, str(tmp_path))
    assert good.count() == 9000
    ratios = quality.compression()
    found = [ratios(t.encode())[0] for _, t in texts if not 100 * quality.counts(t)[4] > 50 * quality.counts(t)[0]]
    assert quality.fit(good) == quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), good_ids(spark, str(tmp_path)))
    low, high = quality.fit(good).limits[1]
    assert len(found) > 8000 and len({len(t) for _, t in texts}) == 1
    assert low == pytest.approx(max(0.32, np.quantile(found, 0.004) - 0.02), abs=1e-12) and high == pytest.approx(min(0.90, max(0.7, np.quantile(found, 0.996) + 0.1)), abs=1e-12)


def test_quantiles(spark):
    r = random.Random(8)
    rows = [(p, r.choice([r.random(), round(r.random(), 2), 0.5])) for p, n in ((0, 1), (3, 7), (8, 2000)) for _ in range(n)]
    out = quality.quantiles(spark.createDataFrame(rows, "place int, ratio double"), (0.004, 0.5, 0.996))
    for p in (0, 3, 8):
        own = [x for q, x in rows if q == p]
        assert out[p] == (len(own), pytest.approx([float(np.quantile(own, s)) for s in (0.004, 0.5, 0.996)], abs=1e-12))
