"""Token counts kept as rollups that are maintained by deltas.

The store is a folder of committed batches. A batch holds signed entries, one per changed document and
tokenizer version: an insert adds its count, a delete takes the old count away, a revision does both.
Beside the entries it holds their sums by source, language and version. Totals are the sums of all
committed batches, so no earlier text is read again. Every attempt at a batch writes entries and sums into
folders of its own, and one empty file, made last, commits both. Readers see the last committed attempt of
each batch only: a repeated commit changes nothing, and one that is lost half way is as if it had not been.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import SPACE, annotate

#: Folder of the public tokenizers' files, and the versions counted.
TOKENIZERS, VERSIONS = "/opt/tokenizers", ("byte_bpe_50k", "words")
KEY = ("source", "lang", "version")
SUMS = "source string, lang string, version string, docs long, tokens long"
_LOADED: dict = {}


def encoder(folder: str, name: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    if (folder, name) not in _LOADED:
        spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[folder, name] = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder, name]


def counted(docs: DataFrame, versions: tuple = VERSIONS, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            lang: str = "lang", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, version, tokens) of every document and version. The version `words` counts
    runs of non-blanks, any other is a tokenizer's rank file. Null and empty texts have 0 tokens."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    per = []
    for i, version in enumerate(versions):
        if version == "words":
            count = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
            plain = plain.withColumn(f"n{i}", count)
        else:
            plain = annotate(plain, "text", f"n{i}", T.LongType(), lambda texts, v=version: [
                len(encoder(folder, v).encode_ordinary(t)) if t else 0 for t in texts])
        per.append(F.struct(F.lit(version).alias("version"), F.col(f"n{i}").alias("tokens")))
    return plain.select("doc_id", "source", "lang", F.inline(F.array(*per)))


def attempts(spark: SparkSession, store: str) -> dict[int, int]:
    """The last committed attempt of each batch, by the names of the marker files."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/commits")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    marks = sorted(tuple(map(int, name.split("."))) for name in names)
    return dict(marks)


def committed(spark: SparkSession, store: str, what: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all committed batches, or of those before a batch; none yet gives an empty table."""
    live = [f"{store}/{what}/batch={b}/attempt={a}" for b, a in attempts(spark, store).items() if before is None or b < before]
    return spark.read.schema(schema).parquet(*live) if live else spark.createDataFrame([], schema)


def entry_schema(spark: SparkSession, store: str, *given: DataFrame | None) -> str:
    """The columns of entries. Ids have the type of those in the store; before the first batch, of the given
    rows; without any, bigint."""
    live = attempts(spark, store)
    kind = spark.read.parquet(f"{store}/entries/batch={min(live)}/attempt={live[min(live)]}") if live else \
        next((df for df in given if df is not None), None)
    return f"doc_id {kind.schema['doc_id'].dataType.simpleString() if kind is not None else 'bigint'}, {SUMS}"


def current(spark: SparkSession, store: str, before: int | None = None, schema: str | None = None) -> DataFrame:
    """(doc_id, source, lang, version, docs, tokens) of the documents in the store, or as they were before
    a batch: their entries summed, those that cancel left out."""
    entries = committed(spark, store, "entries", schema or entry_schema(spark, store), before)
    return entries.groupBy("doc_id", *KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0")


def commit(spark: SparkSession, store: str, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
    """Apply batch number `batch`: `upserts` are counted rows (inserts, or revisions of documents in the
    store), `deletes` are rows with doc_id. The state it changes is that of the batches with lower numbers,
    so that a repeated commit gives the same rows. Deletes of unknown documents do nothing;
    a document both upserted and deleted in one batch is revised; repeated deletes count once; of repeated
    upserts of a document each counts. Rows with a null doc_id are always inserts. Batches with no rows
    commit nothing. Ids are of any type; they are cast to the type of the first batch. Two writers must not
    commit at once."""
    schema = entry_schema(spark, store, upserts, deletes)
    kind = T._parse_datatype_string(schema)["doc_id"].dataType
    own_type = lambda df: df.withColumn("doc_id", F.col("doc_id").cast(kind))
    old = current(spark, store, batch, schema)
    entries = []
    if upserts is not None:
        upserts = own_type(upserts)
        entries.append(upserts.select("doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens"))
        revised = upserts.where("doc_id is not null").select("doc_id", "version").distinct()
        entries.append(old.join(revised, ["doc_id", "version"], "left_semi").select(*negated()))
    if deletes is not None:
        gone = old.join(own_type(deletes).where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
        if upserts is not None:
            gone = gone.join(revised, ["doc_id", "version"], "left_anti")
        entries.append(gone.select(*negated()))
    if not entries:
        return
    attempt = attempts(spark, store).get(batch, 0) + 1
    folder = lambda what: f"{store}/{what}/batch={batch}/attempt={attempt}"
    functools.reduce(DataFrame.unionByName, entries).write.mode("overwrite").parquet(folder("entries"))
    own = spark.read.schema(schema).parquet(folder("entries"))
    own.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(folder("sums"))
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/commits/{batch}.{attempt}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def negated() -> list:
    return ["doc_id", *KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")]


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, version, docs, tokens): sums of the batches' rollups; groups without a document left
    are dropped. Null sources and languages are groups of their own."""
    sums = committed(spark, store, "sums", SUMS)
    return sums.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0")
