"""The stages one after another on the small tables, each against a plain version of what it decides."""

import re

import corpus_pipeline
import tiktoken
from lodestrand.llm import bpe, near, pii, quality, simhash
from lodestrand.llm.queries import good_documents, tokenizer

from .test_operators import WORD, plain_verdict, shares

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        tables[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = tables[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    before, after = tables["quality"]
    bands = quality.fit(good_documents(spark, SF))
    want = {r.doc_id for r in before.collect() if plain_verdict(r.text, bands)[0]}
    assert {r.doc_id for r in after.collect()} == want and len(want) > 0.5 * before.count()

    before, after = tables["near_copies"]
    groups = near.brute_force([(r.doc_id, r.text) for r in before.collect()], simhash.NEAR_SHINGLE)
    assert {r.doc_id for r in after.collect()} == {i for i, c in groups if i == c}

    before, after = tables["personal_data"]
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        if not pii.candidates(r.text):
            assert texts[r.doc_id] == r.text
        for _, a, b in pii.base_spans(r.text):
            assert r.text[a:b] not in texts[r.doc_id]

    before, after = tables["mixing"]
    size, sources, times = {}, {}, {}
    for r in before.collect():
        size[r.doc_id] = len(re.findall(WORD, r.text or ""))
        sources[r.source] = sources.get(r.source, 0) + size[r.doc_id]
    target, words = shares(sources), {}
    for r in after.collect():
        n = len(re.findall(WORD, r.text))
        words[r.source] = words.get(r.source, 0) + n
        times[r.doc_id] = times.get(r.doc_id, 0) + n
    assert words == {k: int(v + 1e-9) for k, v in target.items() if v >= 1}
    assert all(n <= 3 * size[i] for i, n in times.items())

    before, after = tables["bpe"]
    path, pattern = tokenizer()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={}).encode_ordinary
    assert sorted((r.doc_id, r.ids) for r in after.collect()) == sorted((r.doc_id, plain(r.text)) for r in before.collect())
    assert after.where("not round_trip").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_tables_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls in every column, very long and repeated texts, ids that repeat."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(30)
    rows = [(None, None, None, None, None), (5, "", "en", "s", 0), (5, "word " * 60_000, "en", None, 300_000), (7, None, None, "s", None)]
    docs = some.unionByName(some).unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0 and docs.where("not round_trip").count() == 0
