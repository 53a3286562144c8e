"""Helpers shared by the operators: fresh column names, per-batch Arrow annotation, bounded samples,
packed code points and a vectorised hash table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word separators of all contracts: blank and the control characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\f\r"
#: Rows handled at once inside a task, and code points packed at once.
ROWS, CHARS = 256, 1 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name not used in df, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(df: DataFrame, text: str, out: str, kind: T.DataType, fn: Callable[[list], list]) -> DataFrame:
    """df with one more column: fn maps a list of texts (null as None) to a list of values. Rows keep
    their order and all columns; a task holds one Arrow batch and ROWS results at a time."""
    arrow = pa_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                made = pa.array(fn(texts), type=arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once a row. Each depends on the row's running number, which the
    optimizer takes as different at each evaluation, so neither a filter nor a lambda function above
    repeats its expression; the value does not depend on the number."""
    return df.withColumns({n: F.when(F.monotonically_increasing_id() >= 0, c) for n, c in columns.items()})


def text_of(df: DataFrame, text: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(df[text], F.lit(""))


def sampled(df: DataFrame, key: list[str], rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows chosen by a hash of key columns, the same at each run: the share follows the
    row count, so the sample is bounded in expectation whatever the input holds. Repeated rows are
    drawn together."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 40))
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 24) < share)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def packed(texts: list, overlap: int, limit: int = CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of many texts in runs of about `limit`: (row of each piece, start of each piece,
    code points). Texts above the limit come in pieces that share `overlap` code points, so n-grams of
    overlap + 1 code points are seen once each. Null is empty and gives no piece."""
    rows, starts, parts, size = [], [], [], 0

    def flush():
        return np.array(rows), np.array(starts), np.concatenate(parts)

    for row, text in enumerate(texts):
        if not text:
            continue
        codes = code_points(text)
        for at in range(0, max(1, len(codes) - overlap), limit):
            piece = codes[at:at + limit + overlap]
            if size and size + len(piece) > limit:
                yield flush()
                rows, starts, parts, size = [], [], [], 0
            rows.append(row)
            starts.append(size)
            parts.append(piece)
            size += len(piece)
    if size:
        yield flush()


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function over a uint64 array."""
    x = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Lookup:
    """Open addressing over distinct uint64 keys: find(keys) gives each key's place in the given order,
    or -1. Eight bytes of key and four of place for at most four slots a key."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, np.uint64)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._home(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # the last writer of a slot wins
            won = free & (self.place[slot] == left)
            self.key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 3) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        found = self.place[slot]
        wrong = np.flatnonzero((found >= 0) & (self.key[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            now = self.place[slot[wrong]]
            found[wrong] = now
            wrong = wrong[(now >= 0) & (self.key[slot[wrong]] != keys[wrong])]
        return found
