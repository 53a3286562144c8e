"""Language identification by n-gram filters that hold a bitmask of languages.

Training counts letter trigrams by language over all learning documents. A trigram enters the filter
of each language in which it is usual. The filters are bit-sliced: slot j of a table of 64-bit words, one
table for every 64 languages, has bit l set if language l's Bloom filter has its bit j set, so that one look-up and AND of a few
words answers for all languages at once. The filters have a fixed size, whatever the corpus.

Prediction looks up every trigram of a text, takes one popcount a language, corrects it for that
filter's false positives, and the highest share wins.
"""

from __future__ import annotations

import functools
import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import CHARS, annotate, mixed, packed
from tidegauge.session import cut

#: Slots of a table (512 KiB of 64-bit words), hash functions, and languages of a table (bits of a word).
SLOTS_BITS, HASHES, BITS = 16, 3, 64
#: A trigram is usual in a language at this share of its trigrams, and at this part of the highest
#: share that any language gives it.
MIN_SHARE, MIN_PART = 3e-5, 0.25
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("ngrams", T.LongType())])


@dataclass(frozen=True)
class Model:
    """Languages with their false-positive rates; `table` is the bit-sliced filter, a row for every 64 languages."""

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    usual: int  # index of the language with most trigrams: the answer where nothing is known


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if ch.isalpha():
            low = ch.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def trigrams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the piece) of every trigram of lower-case letters and single blanks that has a
    letter in its middle."""
    low = letters()[codes]
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    is_letter = low != 32
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[starts] = True  # a piece begins with a blank or its first letter
    low, piece = low[keep].astype(np.uint64), piece[keep]
    if len(low) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = low[:-2] << np.uint64(42) | low[1:-1] << np.uint64(21) | low[2:]
    inside = (piece[:-2] == piece[2:]) & (low[1:-1] != 32)
    return keys[inside], piece[:-2][inside]


def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate(counts), len(values)).astype(np.int64)


def counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Trigram counts by language over all rows: each task sends one row a language and trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for value, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value:
                    by_lang.setdefault(of, []).append(f" {value} ")
            for of, texts in by_lang.items():
                store = sums.setdefault(of, [[], [], 0])
                for _, starts, codes in packed(texts, 2):
                    found, n = np.unique(trigrams(codes, starts)[0], return_counts=True)
                    store[0].append(found)
                    store[1].append(n)
                    store[2] += len(found)
                    if store[2] > 2 * CHARS:
                        k, c = merged(store[0], store[1])
                        sums[of] = store = [[k], [c], 0]
        for of, (keys, counts, _) in sums.items():
            k, c = merged(keys, counts)
            for at in range(0, len(k), 1 << 16):
                part = k[at:at + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of] * len(part)), pa.array(part), pa.array(c[at:at + (1 << 16)])], ["lang", "gram", "n"])

    return docs.select(text, lang).mapInArrow(run, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from all rows with a language and a text; None if there is no trigram at all. Every
    64 languages share one table of words."""
    grams = cut(counted(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    known = totals.orderBy("lang").collect()
    if not known:
        return None
    index = F.create_map(*[F.lit(x) for i, r in enumerate(known) for x in (r["lang"], i)])
    total = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], float(r["total"]))])
    shares = grams.select("gram", index[F.col("lang")].alias("bit"), (F.col("n") / total[F.col("lang")]).alias("share"))
    usual = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("bit", "share")).alias("of")) \
        .where(F.col("top") >= MIN_SHARE) \
        .select("gram", F.filter("of", lambda x: (x["share"] >= MIN_SHARE) & (x["share"] >= MIN_PART * F.col("top"))).alias("of"))
    words = -(-len(known) // BITS)
    mask = lambda w: F.aggregate(
        F.filter("of", lambda x: F.floor(x["bit"] / BITS) == w), F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"] % BITS)))

    # At most 1 / MIN_SHARE trigrams a language pass, so this fits the driver at any corpus size.
    rows = usual.select("gram", *[mask(w).alias(f"mask{w}") for w in range(words)]).toPandas()
    grams_ = rows["gram"].to_numpy(np.int64).astype(np.uint64)
    table = np.zeros((words, 1 << SLOTS_BITS), np.uint64)
    for w, slot in itertools.product(range(words), slots(grams_)):
        np.bitwise_or.at(table[w], slot, rows[f"mask{w}"].to_numpy(np.int64).astype(np.uint64))
    fill = np.array([bit_of(table[i // BITS], i).mean() for i in range(len(known))])
    most = max(range(len(known)), key=lambda i: (known[i]["total"], -i))
    return Model([r["lang"] for r in known], table, fill**HASHES, most)


def bit_of(words: np.ndarray, lang: int) -> np.ndarray:
    """The bit of a language in words of its table."""
    return words >> np.uint64(lang % BITS) & np.uint64(1)


def slots(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each key under the hash functions."""
    shift = np.uint64(64 - SLOTS_BITS)
    return [(mixed(keys, seed) >> shift).astype(np.int64) for seed in range(HASHES)]


def predict(model: Model | None, texts: list) -> list[dict]:
    """Language, score (its corrected share among all languages' shares) and trigrams of each text.
    `und` with score 0 if a text is null, empty or without a letter, or nothing was learned. A text
    with letters of which no trigram is known gets the language with most training data, score 0."""
    n_langs = len(model.langs) if model else 0
    hits, total = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
    for rows, starts, codes in packed([f" {t} " if t else t for t in texts], 2) if model else ():
        keys, piece = trigrams(codes, starts)
        masks = functools.reduce(np.bitwise_and, (model.table[:, s] for s in slots(keys)))
        row = rows[piece]
        total += np.bincount(row, minlength=len(texts))
        for i in range(n_langs):
            hits[:, i] += np.bincount(row, bit_of(masks[i // BITS], i), len(texts))
    out = []
    for i, n in enumerate(total):
        if not n:
            out.append({"lang": "und", "score": 0.0, "ngrams": 0})
            continue
        share = np.clip((hits[i] / n - model.false_rate) / (1 - np.minimum(model.false_rate, 0.999)), 0, 1)
        best = int(np.argmax(share)) if share.max() > 0 else model.usual
        score = float(share[best] / share.sum()) if share.sum() > 0 else 0.0
        out.append({"lang": model.langs[best], "score": score, "ngrams": int(n)})
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column `out` (lang, score, ngrams). Every row and column stays; nulls, empty
    and very long texts (taken in overlapping pieces), repeated rows and empty tables are covered by
    `predict`."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 512 KiB of table for every 64 languages, at any size
    return annotate(docs, text, out, RESULT, lambda texts: predict(held.value, texts))
