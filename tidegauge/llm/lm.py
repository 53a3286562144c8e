"""Cross-entropy difference between matched character n-gram models of a target and a background corpus.

Both models are interpolated n-gram models of the same order, smoothing and vocabulary: the code points
of the whole background corpus in lower case (code points above 0xFFFF share one symbol), which are the
tokens. A document's score is the mean over its tokens of the target's loss minus the background's, in
nats: the lower, the closer to the target.

Counts cover every document. Every n-gram of a scored document is in the table of counts, since the
background is the corpus itself, so each table row can carry its two losses, and a document's sums are
look-ups. The table is sent to the executors in blocks of bounded size; each block adds its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import CHARS, Lookup, annotate, fresh, packed
from tidegauge.session import cut

#: Symbols of context and token together, weight of an order against the lower ones, start symbol, shared symbol.
ORDER, KEEP, START, OTHER = 4, 0.8, 1, 0xFFFD
#: Table rows sent to the executors at once (24 bytes each, and at most 48 for the look-up).
BLOCK = 1 << 20
SUMS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("target", "background")] + [T.StructField("n", T.LongType())])


def symbols(texts: list) -> list:
    """Lower-case texts with the start symbols in front; null stays None and empty stays empty."""
    return [chr(START) * (ORDER - 1) + t.lower() if t else t for t in texts]


def keys_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram as four 16-bit symbols, index of the piece) of every token."""
    small = np.where(codes > 0xFFFF, OTHER, codes).astype(np.uint64)
    n = len(small) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.zeros(n, np.uint64)
    for i in range(ORDER):
        keys = keys << np.uint64(16) | small[i:i + n]
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    inside = piece[:n] == piece[ORDER - 1:]
    return keys[inside], piece[:n][inside]


def counts(docs: DataFrame, text: str, target: str) -> DataFrame:
    """(gram, background, target) over all rows; each task sends one row an n-gram."""

    def summed(parts: list) -> list:
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(keys, *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            chosen = np.array(batch.column(1).to_pylist(), bool)
            for rows, starts, codes in packed(symbols(batch.column(0).to_pylist()), ORDER - 1):
                keys, piece = keys_of(codes, starts)
                keys, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
                parts.append((keys, n, np.bincount(inverse, chosen[rows][piece], len(keys)).astype(np.int64)))
                held += len(keys)
                if held > 2 * CHARS:
                    parts = summed(parts)
                    held = len(parts[0][0])
        for keys, n, t in summed(parts) if parts else ():
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)].astype(np.int64)) for x in (keys, n, t)],
                                                 ["gram", "background", "target"])

    return docs.select(text, target).mapInArrow(run, "gram long, background long, target long") \
        .groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def losses(table: DataFrame) -> DataFrame:
    """(gram, target, background): the two losses of an n-gram's last symbol. The counts of lower orders
    are sums of the table. From the uniform share of the vocabulary up, each order takes KEEP of its own
    estimate and the rest from the order below; an order whose context the corpus lacks is left out."""
    context = lambda n: F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))
    suffix = lambda n: F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1))
    corpora, out = ("background", "target"), table
    sums = lambda label: [F.sum(c).alias(f"{c}_{label}") for c in corpora]
    for n in range(1, ORDER):
        own = table.groupBy(suffix(n).alias(f"s{n}")).agg(*sums(f"s{n}"))
        out = out.join(own, suffix(n) == F.col(f"s{n}"))
    for n in range(2, ORDER + 1):
        within = table.groupBy(context(n).alias(f"c{n}")).agg(*sums(f"c{n}"))
        out = out.join(within, context(n) == F.col(f"c{n}"))
    symbol = table.groupBy(suffix(1)).agg(*sums("c1"))
    whole = symbol.agg(F.count(F.lit(1)).alias("vocabulary"), *[F.sum(f"{c}_c1").alias(f"{c}_c1") for c in corpora])
    out = out.crossJoin(F.broadcast(whole))  # one row of totals

    def loss(corpus: str) -> Column:
        p = 1.0 / F.col("vocabulary")
        for n in range(1, ORDER + 1):
            hits, within = F.col(f"{corpus}_s{n}" if n < ORDER else corpus), F.col(f"{corpus}_c{n}")
            p = F.when(within > 0, KEEP * hits / within + (1 - KEEP) * p).otherwise(p)
        return -F.log(p)

    return out.select("gram", *[loss(c).alias(c) for c in ("target", "background")])


def score(docs: DataFrame, target: Column, text: str = "text", out: str = "lm", block: int = BLOCK) -> DataFrame:
    """docs with a struct column `out`: `tokens`, mean losses `target` and `background`, and `diff`, target
    minus background. `target` is a condition on docs that marks the target corpus (null counts as false);
    the background is all rows. Null and empty texts have 0 tokens and null losses; repeated rows count
    each; very long texts are taken in overlapping pieces; without any target row the target model is
    uniform; an empty table gives an empty result. Other columns stay."""
    spark, mark = docs.sparkSession, fresh(docs, "is_target")
    marked = docs.withColumn(mark, F.coalesce(target, F.lit(False)))
    table = cut(losses(cut(counts(marked, text, mark))))
    blocks = max(1, -(-table.count() // (block * 3 // 4)))  # hashed blocks differ a little in size
    sums, parts = docs, []
    for b in range(blocks):
        own = table.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b).toPandas()
        held = spark.sparkContext.broadcast((Lookup(own["gram"].to_numpy(np.int64).astype(np.uint64)),
                                             own["target"].to_numpy(float), own["background"].to_numpy(float)))
        parts.append(fresh(sums, "part"))
        sums = annotate(sums, text, parts[-1], SUMS, lambda texts, held=held: summed_losses(texts, *held.value))
    total = {n: sum((F.col(f"{p}.{n}") for p in parts), F.lit(0)) for n in ("target", "background", "n")}
    mean = {n: F.when(total["n"] > 0, total[n] / total["n"]) for n in ("target", "background")}
    return sums.withColumn(out, F.struct(
        total["n"].alias("tokens"), mean["target"].alias("target"), mean["background"].alias("background"),
        (mean["target"] - mean["background"]).alias("diff"))).drop(*parts)


def summed_losses(texts: list, lookup: Lookup, target: np.ndarray, background: np.ndarray) -> list[dict]:
    """For each text the losses and number of its tokens that this block of the table knows."""
    t, b, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for rows, starts, codes in packed(symbols(texts), ORDER - 1):
        keys, piece = keys_of(codes, starts)
        at = lookup.find(keys)
        row, at = rows[piece][at >= 0], at[at >= 0]
        t += np.bincount(row, target[at], len(texts))
        b += np.bincount(row, background[at], len(texts))
        n += np.bincount(row, minlength=len(texts))
    return [{"target": float(x), "background": float(y), "n": int(z)} for x, y, z in zip(t, b, n)]
