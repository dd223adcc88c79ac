import pytest
from pyspark.sql import functions as F

from souk.llm import ids, queries


@pytest.mark.parametrize("ranges", [4096, 2])
def test_rows_among_ids(spark, monkeypatch, ranges):
    """As a semi join, by bitmaps or where the ids fill too many of them."""
    monkeypatch.setattr(ids, "RANGES", ranges)
    known = [0, 1, -1, 7, 8, 9, 32767, 32768, 32769, 65536, -32768, 10**15, 2**63 - 1, -(2**63), 7, None]
    near = {k + d for k in known if k is not None for d in (-9, -8, -1, 0, 1, 8, 32768) if abs(k + d) < 2**63} | {-(2**63)}
    rows = [(k, f"t{k}") for k in near] + [(7, "again"), (7, "again"), (None, "none")]
    docs, few = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in known], "doc_id long")
    found = ids.among(docs, few)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[0] is not None and r[0] in known)
    assert ids.among(docs, few.limit(0)).count() == 0


def test_texts_of_trusted_documents_are_not_shuffled(spark, tmp_path, monkeypatch):
    """However many labels there are."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(queries, "written", lambda df, name: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many labels
    try:
        found = queries.trusted(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning(doc_id" not in plan
    assert found.count() == 100
