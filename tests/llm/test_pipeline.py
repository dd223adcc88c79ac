import pytest

import corpus_pipeline
from souk.llm import neardup
from souk.llm.queries import ORACLE, QUERIES
from tests.llm import cases


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).persist()
        kept[name] = out.count()
        if name != "token_output":
            assert out.columns == columns
            docs = out
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    lettered = [(r.doc_id, r.text) for r in rows if any(map(str.isalpha, r.text or ""))]
    assert kept["language_id"] == len(lettered)
    root, _ = cases.near_groups(lettered)
    assert kept["ngram_jaccard_join"] == len(set(root))
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = cases.low_words(r.text)
        windows.update(tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9)))
    clean = [lettered[i] for i in set(root)]
    clean = [x for x in clean if not any(tuple(w[a : a + n]) in windows for w in [cases.low_words(x[1])] for n in {len(k) for k in windows} for a in range(len(w) - n + 1))]
    assert kept["benchmark_decontamination"] == len(clean)
    assert kept["token_output"] == kept["source_mixing"]


def test_run_and_registration(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert neardup.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).count() == 200


CLASHES = ("_dup_text", "_dup_rows", "_hit_text", "_hit_key", "_mix_size", "_mix_times", "hash", "group", "times", "part", "_c0", "_text")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_odd_rows(spark, small, name):
    """Null keys, null, empty and very long texts, repeated rows and clashing names; then no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = cases.clash(spark.createDataFrame(cases.sample(9, 60, 20_000), cases.DOCS).repartition(3), *CLASHES)
    out = stage(spark, docs, small)
    if name != "token_output":
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r[c] for r in rows for c in CLASHES} <= {"other"}
        before = {(r.doc_id, r.text, r.source) for r in docs.collect()}
        assert rows and {(r.doc_id, r.text, r.source) for r in rows} <= before
        wordless = [r for r in rows if not cases.low_words(r.text)]
        assert bool(wordless) == (name in ("ngram_jaccard_join", "benchmark_decontamination"))
    else:
        assert out.count() == docs.count()
    assert stage(spark, docs.where("false"), small).collect() == []
