"""Near copies against the exact Jaccard likeness of all pairs."""

import random

import corpus_pipeline
from lodestrand.llm import near, quality, simhash
from lodestrand.llm.queries import good_documents

SF = "/root/testdata/sf0.001"


def changed(r, words, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"x{r.randrange(10**9)}"
    return " ".join(out)


def test_groups_by_likeness(spark):
    r, texts = random.Random(7), []
    for _ in range(30):  # likeness of the second to the first: 0.82 (8 words), of the third 0.74 at most
        words = [f"w{r.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), changed(r, words, 8), changed(r, words, 13)]
    words = [f"v{r.randrange(5000)}" for _ in range(300)]
    texts += [changed(r, words, r.choice((2, 3, 9))) for _ in range(60)]  # a dense group, and texts around it
    texts += ["", None, "one two", "One  two", "one three"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(near.brute_force(rows, simhash.NEAR_SHINGLE))
    assert {x.doc_id: x.component_id for x in near.groups(docs, simhash.NEAR_SHINGLE).collect()} == want
    assert sorted(x.doc_id for x in simhash.one_of_each(docs).collect()) == sorted({i for i, c in want.items() if i == c})
    assert all(want[3 * k] == want[3 * k + 1] for k in range(30))


def test_rows_that_share_a_doc_id(spark):
    """Unrelated texts under one doc_id both stay; copies go, whatever their ids; columns of any name pass."""
    r = random.Random(2)
    x, y, z = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (None, z), (None, z), (None, y), (7, None), (8, ""), (9, x + " more"), (5, y)]
    docs = spark.createDataFrame([(*p, i, "c", "h") for i, p in enumerate(rows)], "doc_id long, text string, n int, component string, h string")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((p.doc_id or 0, p.text or "") for p in out.collect()) == sorted([(3, x), (5, y), (0, z), (7, "")])
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_stage_by_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.kept(docs, quality.fit(good_documents(spark, SF)))
    groups = near.brute_force([(r.doc_id, r.text) for r in good.collect()], simhash.NEAR_SHINGLE)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, good, SF).collect()} == {i for i, c in groups if i == c}
