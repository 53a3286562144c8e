"""Each stage on its own input against plain versions, and the whole on the smallest tables."""

import brute
import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("language", F.lit(1)).withColumn("fp", F.lit("x"))
    docs = docs.union(spark.createDataFrame([(10**6, None, None, None, 0, 1, "x"), (10**6 + 1, "12 34", "en", "s", 0, 1, "x")], docs.schema))
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = [r.asDict() for r in docs.collect()]
        after = stage(spark, docs, SF)
        rows = [r.asDict() for r in after.collect()]
        if name != "mixture":
            assert after.columns == docs.columns
        if name == "language":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} == {10**6, 10**6 + 1}
        if name == "near_duplicates":
            sets = [(r["doc_id"], brute.shingles(r["text"])) for r in before]
            low = brute.components(sets, lambda a, b: a == b or brute.similarity(a, b) >= 0.8)
            group = dict(zip((d for d, _ in sets), low))
            assert sorted(group[r["doc_id"]] for r in rows) == sorted(set(low))  # exactly one of each group
        if name == "leaks":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in rows}
            assert gone and gone == {r["doc_id"] for r in before if any(b in r["text"] for b in bench)}
        if name == "secrets":
            assert len(rows) == len(before) and not any(brute.secrets(r["text"]) for r in rows)
            assert [r for r in before if not brute.secrets(r["text"])][:1][0] in rows
        if name == "mixture":
            assert all(r["taken"] in (r["size"], 2 * r["size"]) for r in rows)
        docs = spark.createDataFrame(after.rdd, after.schema) if rows else after


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert P.mixture(spark, docs, SF).count() == 0


def test_run(spark):
    assert P.run(spark, SF).count() > 50
