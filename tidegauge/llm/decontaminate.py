"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Texts are compared as lower-case letters and digits with single blanks between words. An item of m
characters occurs in a text with at most k edits only if item and text share m + 1 - q (k + 1) q-grams
whose diagonals (text position - item position) lie within k of each other. Diagonals are cut into
overlapping bands, so that each such set lies whole in one band; bands that reach the count are
retained and aligned within the band, with a free start and end in the text.

An item below LEAST characters has no edit to spare and must stand between word borders: there the lemma
asks for one shared q-gram of the item's own length with its two borders, which is looked up at the words
of the text. Such an item needs LEAST_WORDS words; fewer words, or none, tell no leak from plain language,
and `unsearched` counts these items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import Lookup, annotate, code_points, fresh

#: Length of a q-gram, edits as a share of an item's length, the shortest item that may have edits, and the
#: fewest words of a shorter one.
Q, EDITS, LEAST, LEAST_WORDS = 8, 0.08, 40, 3
#: Characters of benchmark text searched in one pass over the documents, and hits expanded at once.
BLOCK, HITS = 1 << 20, 1 << 20
#: Bands aligned in one step.
TOGETHER = 2048


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Compared code points, and for each its place in the text. Lower case is taken where it is one
    code point; everything but letters and digits is one blank between words."""
    codes = fold_table()[code_points(text)]
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    if len(at) and blank[at[-1]]:
        at = at[:-1]
    return codes[at], at


_TABLE: list = []


def fold_table() -> np.ndarray:
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            ch = chr(code)
            if ch.isalnum():
                low = ch.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _TABLE.append(table)
    return _TABLE[0]


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram; q is a power of two."""
    h, base, width = codes.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while width < q:
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & (2**64 - 1), width * 2
    return h


def bits(keys: np.ndarray) -> np.ndarray:
    """Each key's place in the bitmap. The last characters of a q-gram reach the upper bits of its hash only by this product."""
    return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).view(np.int64)


@dataclass
class Block:
    """Part of the benchmark: its items' code points, the inverted index of their q-grams, and for each
    length of short items (with their borders) the items by q-gram of that length."""

    items: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    lookup: Lookup
    bitmap: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, dict[int, list[int]]]


def block_of(texts: list[str], q: int = Q, edits: float = EDITS) -> Block:
    items = [folded(t)[0] for t in texts]
    sizes = np.array([len(x) for x in items])
    budget = np.maximum(np.minimum((edits * sizes).astype(np.int64), (sizes + 1) // q - 2), 0)
    short: dict[int, dict[int, list[int]]] = {}
    for i in np.flatnonzero(sizes < LEAST).tolist():
        own = bordered(items[i])
        short.setdefault(len(own), {}).setdefault(int(grams_at(own, np.zeros(1, np.int64), [len(own)])[len(own)][0]), []).append(i)
    keys = [grams(x, q) if len(x) >= LEAST else np.zeros(0, np.uint64) for x in items]
    every = np.concatenate(keys)
    item = np.repeat(np.arange(len(items)), [len(k) for k in keys])
    place = np.concatenate([np.arange(len(k)) for k in keys])
    values, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    bitmap = np.zeros(1 << 20, bool)
    bitmap[bits(values)] = True
    return Block(items, budget, sizes + 1 - q * (budget + 1), Lookup(values), bitmap,
                 np.cumsum(count) - count, count, item[order], place[order], short)


def bordered(codes: np.ndarray) -> np.ndarray:
    """The code points between two blanks."""
    return np.concatenate([[32], codes, [32]]).astype(np.uint32)


def grams_at(codes: np.ndarray, starts: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size a 64-bit polynomial hash of the stretch of that size at each start that has room
    (starts ascend), from one running sum over the code points."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(len(codes) + 1, base, np.uint64))
        back = np.multiply.accumulate(np.full(len(codes) + 1, pow(base, -1, 2**64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers[:-1], dtype=np.uint64)])
        out = {}
        for size in sizes:
            own = starts[:np.searchsorted(starts, len(codes) - size, "right")]
            out[size] = (sums[own + size] - sums[own]) * back[own]
    return out


def short_items(block: Block, codes: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """The short items that stand in the text between word borders: (0, start, end) of the first place."""
    if not block.short or not len(codes):
        return {}
    text, out = bordered(codes), {}
    starts = np.flatnonzero(text[:-1] == 32)
    for size, keys in grams_at(text, starts, sorted(block.short)).items():
        known = block.short[size]
        for at in np.flatnonzero(np.isin(keys, np.array(list(known), np.uint64))).tolist():
            begin = int(starts[at])
            for item in known[int(keys[at])]:
                if item not in out and np.array_equal(text[begin + 1:begin + size - 1], block.items[item]) and text[begin + size - 1] == 32:
                    out[item] = (0, begin, begin + size - 2)
    return out


def standing(item: np.ndarray, text: np.ndarray, low: int, high: int) -> int:
    """The first place from low up to high, not included, at which the text holds the item as it is; -1 if there is none."""
    low = max(low, 0)
    stretch, own = text[low:max(high - 1 + len(item), 0)].tobytes(), item.tobytes()
    at = stretch.find(own)
    while at % item.itemsize and at >= 0:
        at = stretch.find(own, at + 1)
    return at if at < 0 else low + at // item.itemsize


def align(items: np.ndarray, text: np.ndarray, low: np.ndarray, k: int) -> list[tuple[int, int, int] | None]:
    """Fewest edits of each item (a row; all of one length) against a stretch of text whose start lies on
    diagonals low to low + 2 k + 1, with all cells within k of them; (edits, start, end), the leftmost end
    among the best; None above k. Items that stand there as they are need no table. All other rows take a step
    at once; those above k everywhere are left."""
    m = items.shape[1]
    width, far = 4 * k + 2, 1 << 20
    first = [standing(item, text, at - k, at - k + width) for item, at in zip(items, low.tolist())]
    out = [None if at < 0 else (0, at, at + m) for at in first]
    alive = np.flatnonzero(np.array(first) < 0)
    if not len(alive):
        return out
    n, items, low = len(alive), items[alive], (low[alive] - k).reshape(-1, 1)
    steps = np.arange(width, dtype=np.int32)
    origin = (steps + low).astype(np.int32)
    line = np.where((origin < 0) | (origin > len(text)), far, 0).astype(np.int32)
    edge, zero = np.full((n, 1), far, np.int32), np.zeros((n, 1), np.int32)
    for i in range(m):
        at = steps + low + i  # the text position that a cell of this row consumes on its diagonal
        ok = (at >= 0) & (at < len(text))
        same = ok & (text[np.clip(at, 0, len(text) - 1)] == items[:, i:i + 1])
        take = np.where(ok, line + ~same, far)
        skip = np.concatenate([line[:, 1:], edge], 1) + 1  # the item's character has no partner
        better = skip < take
        now = np.where(better, skip, take)
        start = np.where(better, np.concatenate([origin[:, 1:], zero], 1), origin)
        spread = np.minimum.accumulate(now - steps, 1) + steps  # text characters without a partner
        source = np.maximum.accumulate(np.where(now == spread, steps, 0), 1)
        origin = np.take_along_axis(start, source, 1)
        line = np.where(at + 1 > len(text), far, spread)
        left = line.min(1) <= k
        if not left.all():
            alive, low, line, origin, items, edge, zero = (x[left] for x in (alive, low, line, origin, items, edge, zero))
            if not len(alive):
                return out
    best = line.argmin(1)
    for row, cell in enumerate(best.tolist()):
        out[alive[row]] = (int(line[row, cell]), int(origin[row, cell]), cell + int(low[row, 0]) + m)
    return out


def search(block: Block, text: str | None) -> list[dict]:
    """Every item of the block that the text holds within its edit budget, with the best place."""
    if not text:
        return []
    codes, at = folded(text)
    out = long_items(block, codes) | short_items(block, codes)
    return [{"item": i, "edits": e, "start": int(at[s]), "end": int(at[t - 1]) + 1} for i, (e, s, t) in sorted(out.items())]


def long_items(block: Block, codes: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """(edits, start, end) of the items of LEAST characters or more, by q-gram counts in bands."""
    keys = grams(codes)
    near = np.flatnonzero(block.bitmap[bits(keys)])
    if not len(near):
        return {}
    of = block.lookup.find(keys[near])
    near, of = near[of >= 0], of[of >= 0]
    tally: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(block.count[of])
    begin = 0
    while begin < len(near):  # hits are expanded in bounded parts, long texts and usual q-grams included
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, "right")))
        n = block.count[of[begin:stop]]
        which = np.repeat(block.first[of[begin:stop]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = block.item[which]
        diagonal = np.repeat(near[begin:stop], n) - block.place[which] + (1 << 20)
        width = block.budget[item] + 1
        band = diagonal // width
        tally.append(np.unique(item << 40 | band, return_counts=True))
        begin = stop
    if len(tally) > 1:
        band, inverse = np.unique(np.concatenate([b for b, _ in tally]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([c for _, c in tally])).astype(np.int64)
    elif tally:
        band, counts = tally[0]
    else:
        return {}
    # A band and its upper neighbour make one overlapping band: k + 1 diagonals fit in some pair.
    follows = np.append(band[1:] == band[:-1] + 1, False)
    both = counts + np.where(follows, np.append(counts[1:], 0), 0)
    reach = np.flatnonzero(both >= block.least[band >> 40])
    if not len(reach):
        return {}
    # By the lemma a band has at least as many edits as its missing q-grams need: the least bound first, and
    # a band that cannot beat the item's best so far, nor equal it further left, is not aligned. Bands of
    # one item over equal stretches of text are aligned once. Rounds take one band of each item, two, four.
    item = band[reach] >> 40
    least = np.maximum(-((both[reach] - block.least[item] - Q * block.budget[item]) // Q), 0)
    low = (band[reach] & ((1 << 40) - 1)) * (block.budget[item] + 1) - (1 << 20)
    order = np.lexsort((low, least, item))
    item, least, low = item[order], least[order], low[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    waiting = {int(item[f]): (int(f), int(t)) for f, t in zip(first, np.append(first[1:], len(item)))}
    out: dict[int, tuple] = {}
    seen: dict[tuple, tuple | None] = {}
    share = 1
    while waiting:
        tried: dict[tuple[int, int], list] = {}
        for of, (begin, end) in list(waiting.items()):
            k, m = int(block.budget[of]), len(block.items[of])
            for i in range(begin, min(begin + share, end)):
                start = int(low[i]) - k
                if of in out and (int(least[i]), start) > out[of][:2]:
                    continue
                stop = start + 4 * k + 1 + m
                stretch = (of, codes[max(start, 0):max(stop, 0)].tobytes(), min(start, 0), stop >= len(codes))
                if stretch not in seen:
                    seen[stretch] = None
                    tried.setdefault((m, k), []).append((of, int(low[i]), stretch))
                elif seen[stretch]:
                    e, s, t = seen[stretch]
                    out[of] = min(out.get(of, (m, 0, 0)), (e, s + int(low[i]), t + int(low[i])))
            if begin + share < end:
                waiting[of] = (begin + share, end)
            else:
                del waiting[of]
        for (m, k), some in tried.items():
            for at in range(0, len(some), TOGETHER):
                part = some[at:at + TOGETHER]
                got = align(np.stack([block.items[of] for of, _, _ in part]), codes, np.array([x for _, x, _ in part]), k)
                for (of, base, stretch), g in zip(part, got):
                    if g:
                        seen[stretch] = (g[0], g[1] - base, g[2] - base)
                        out[of] = min(out.get(of, (m, 0, 0)), g)
        share *= 2
    return out


def searched(codes: np.ndarray) -> bool:
    """Whether an item can be told from plain language: LEAST compared characters or LEAST_WORDS words."""
    return len(codes) >= LEAST or (len(codes) > 0 and int((codes == 32).sum()) + 1 >= LEAST_WORDS)


def unsearched(benchmark: DataFrame, text: str = "text") -> int:
    """How many items of the benchmark, null ones too, are not searched."""
    kept = annotate(benchmark.select(F.col(text).alias("text")), "text", "kept", T.BooleanType(), lambda texts: [
        bool(t) and searched(folded(t)[0]) for t in texts])
    return kept.where("not kept").count()


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[tuple[list, Block]]:
    """The benchmark in blocks of at most about BLOCK characters: what is sent to the executors at once
    is bounded however large the benchmark is. One stretch is brought to the driver at a time. Null items
    and those that `searched` refuses are left out."""
    ids, texts, size = [], [], 0
    items = benchmark.where(F.col(text).isNotNull()).select(item_id, text).orderBy(item_id, text)
    for row in items.toLocalIterator():
        codes = folded(row[1])[0]
        n = len(codes)
        if not searched(codes):
            continue
        if size and size + n > BLOCK:
            yield ids, block_of(texts)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    if texts:
        yield ids, block_of(texts)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end) for each document and benchmark item that occurs in it with at
    most EDITS of its compared length as edits; start and end are code points of the text. Null and empty
    texts match nothing, very long texts are searched whole, repeated rows of docs give repeated rows,
    repeated items are searched each, a null id stays null; an empty table gives an empty result. Of places
    with equally few edits the leftmost is given. Extra columns of either table do not matter."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark, out = docs.sparkSession, None
    kind = T.StructType([T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("edits", T.IntegerType()),
                         T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    for ids, block in blocks(benchmark, item_id, item_text):
        held = spark.sparkContext.broadcast(block)
        names = spark.sparkContext.broadcast(ids)  # bounded as the block is
        found = annotate(plain, "text", "found", T.ArrayType(kind), lambda texts, held=held, names=names: [
            [(names.value[x["item"]], x["edits"], x["start"], x["end"]) for x in search(held.value, t)] for t in texts])
        one = found.select("doc_id", F.inline("found").alias("item_id", "edits", "start", "end"))
        out = one if out is None else out.union(one)
    empty = T.StructType([plain.schema["doc_id"], *kind.fields])
    return spark.createDataFrame([], empty) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay as they were. Rows with a null or
    empty text stay, and all rows if the benchmark is empty."""
    kept = docs
    for _, block in blocks(benchmark, item_id, item_text):
        held, hit = docs.sparkSession.sparkContext.broadcast(block), fresh(docs, "leaks")
        kept = annotate(kept, text, hit, T.BooleanType(), lambda texts, held=held: [bool(search(held.value, t)) for t in texts])
        kept = kept.where(~F.col(hit)).drop(hit)
    return kept
