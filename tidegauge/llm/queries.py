"""One query per operator over the whole tables, and the check SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (ann, decontaminate, langid, lm, mixing, pii, prefix_trie, quality, secret_scan, simhash,
                           token_rollup, variants, warc)
from tidegauge.llm.check_sql import SQL  # noqa: F401
from tidegauge.session import cut, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), out="pii").drop("text")
    base = F.filter("pii", lambda s: s["base"])
    return found.select("doc_id", *[number(base, k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out))
    named = langid.identify(docs.select("doc_id", "text"), model, out="language")
    return named.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is the documents labelled as good; ids are unique, so the labels' ids are joined in. The texts
    are shuffled once for it, at any size, and written: the counts and the scores both read the marked table."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    scored = lm.score(cut(docs), F.col("good"), out="lm")
    return scored.select("doc_id", F.col("lm.tokens").alias("n_tokens"), *[
        F.round(f"lm.{c}", 6).alias(c) for c in ("target", "background", "diff")])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), out="secrets").drop("text")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return docs.select("doc_id", *[number(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                       F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")) \
        .select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 1 inserts all documents; batch 2 revises those with a repeated line, which is taken out, and
    deletes the ones labelled toxic; batch 2 is committed twice."""
    store = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    token_rollup.commit(spark, store, 1, token_rollup.counted(docs))
    lines = F.split("text", "\n")
    revised = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    second = token_rollup.counted(revised.join(toxic, "doc_id", "left_anti"))
    for _ in range(2):
        token_rollup.commit(spark, store, 2, second, toxic)
    return token_rollup.totals(spark, store)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, out="quality").select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = warc.archived(spark, pages)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.groups(table(spark, sf_dir, "documents"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_language, op3_decontamination, op4_cross_entropy, op5_secrets, op6_simhash, op7_mixing, op8_token_counts,
    op9_quality, op10_warc, op11_prefix_trie, op12_variants, op13_nearest)}
