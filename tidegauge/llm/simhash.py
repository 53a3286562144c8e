"""SimHash near-duplicates: an inverted index on byte positions, count filtering, verification.

Two 64-bit fingerprints that differ in at most `radius` = 2 bits share at least 6 of their 8 bytes at
equal positions. One byte alone would give posting lists of 1/256 of all rows, so an index entry is a
set of four byte positions with their values: the bytes are taken as four pairs, at least two pairs are
untouched by two flips, and the six choices of two pairs meet every pair of fingerprints in question.
For each candidate pair the shared positional bytes are tallied, pairs below six are dropped, and the
rest is verified by the bits themselves.

A posting list of more than `MOST` fingerprints is not expanded into pairs. Its members share 32 bits,
so each sends its 32 one-flip variants of the others and itself: two of them are at most two flips
apart exactly if they share such a variant, and a link to the smallest owner of a shared variant
keeps them connected. This is exact, and linear in the members.

Texts at a shingle similarity of 0.8 differ in about ten of the 64 bits, where no byte need be shared, so
for a wanted similarity `cluster` adds links from a longer fingerprint: POSITIONS bytes, each of the least
of all shingle hashes under one of as many hash functions, of which two texts share their similarity's
part. Its index entries hold BAND positions, and the shared positional bytes of each candidate pair are tallied. Long
lists are split by further positions until they are short; a linked group in one is joined through one member.
The tally is a filter with a margin; of the pairs it passes the shared shingles are counted, and those at the
similarity or more are kept.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import annotate, fresh, mixed, with_held
from tidegauge.session import cut

RADIUS, MOST, WORDS, SEED = 2, 16, 3, 42
LEAST_BYTES = 8 - RADIUS
PAIRS = list(itertools.combinations(range(4), 2))
#: Bytes of the longer fingerprint, positions in an index entry and entries of a fingerprint: at a similarity
#: of 0.8 one entry is shared with probability 0.33, none of the 24 with 0.00007.
POSITIONS, BAND, BANDS = 256, 5, 24
#: Standard deviations that the tally of bytes may stay below the similarity: one pair in three million is lost.
MARGIN = 5
#: Standard deviations above the similarity from which a link is taken as certain, and finer keys of a long list's member.
SURE, SPLITS = 3, 3
#: Members of a list that all meet each other; in a longer one they meet one member first.
FEW = 8
#: Shingle hashes put under all functions at once: 2 KB each.
AT_ONCE = 1 << 9
_ODD, _SHIFT = np.random.default_rng(SEED).integers(0, 2**64, (2, POSITIONS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS, piece: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, in pieces; nothing without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = list(itertools.accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    ends = ends[words - 1:] or ends[-1:]
    for at in range(0, len(ends), piece):
        own = ends[at:at + piece]
        yield np.array([xxhash.xxh64_intdigest(joined[s:e - 1], SEED) for s, e in zip(starts[at:], own)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS, piece: int = 1 << 16) -> int:
    """The majority of each bit of the shingles' XXH64 as a signed 64-bit number; zero without a word."""
    return majority(shingles(text, words, piece))


def majority(pieces: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in pieces:  # long texts in pieces: bits take 64 bytes a shingle
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        n += len(hashes)
        for some in range(0, len(bits), 255):
            ones += bits[some:some + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def different(pieces: Iterable[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *pieces]))


def distinct_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The XXH64 of the different shingles, as signed numbers in order."""
    return different(shingles(text, words)).view(np.int64)


def signature(text: str | None, words: int = WORDS) -> bytes | None:
    """The longer fingerprint: a byte of the least shingle hash under each function; null without a word."""
    return sketch(text, words)["sig"]


def sketch(text: str | None, words: int = WORDS) -> dict:
    """The fingerprint `fp`, the longer one `sig` and `node`, a 64-bit hash of the set of different shingles, from one
    reading of the shingles."""
    pieces = list(shingles(text, words))
    hashes, least = different(pieces), None
    for at in range(0, len(hashes), AT_ONCE):
        under = hashes[at:at + AT_ONCE] * _ODD
        under += _SHIFT
        own = under.min(1)
        least = own if least is None else np.minimum(least, own)
    sig = None if least is None else (mixed(least, 5) >> np.uint64(56)).astype(np.uint8).tobytes()
    return {"fp": majority(pieces), "sig": sig, "node": int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))}


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words: int = WORDS) -> DataFrame:
    """docs with the fingerprint as a long column; null and empty texts give zero."""
    return annotate(docs, text, out, T.LongType(), lambda texts: [fingerprint(t, words) for t in texts])


def byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes are equal."""
    return sum((F.when(byte(a, i) == byte(b, i), 1).otherwise(0) for i in range(8)), F.lit(0))


def postings(fps: DataFrame) -> DataFrame:
    """(slot, bytes, fp): the six index entries of each fingerprint."""
    pair = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    entries = [F.struct(F.lit(k).alias("slot"), (pair(i) * 65536 + pair(j)).alias("bytes"))
               for k, (i, j) in enumerate(PAIRS)]
    return fps.select("fp", F.inline(F.array(*entries)).alias("slot", "bytes"))


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) links between distinct fingerprints: every pair from short posting lists, and for long
    lists a star around each shared variant, which connects the same fingerprints."""
    posted = cut(postings(fps))
    lists = posted.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = cut(posted.join(lists, ["slot", "bytes"]))

    short = met.where(F.col("n") <= most)
    a, b = short.select("slot", "bytes", F.col("fp").alias("a")), short.select("slot", "bytes", F.col("fp").alias("b"))
    pairs = a.join(b, ["slot", "bytes"]).where(F.col("a") < F.col("b")) \
        .where(shared_bytes(F.col("a"), F.col("b")) >= LEAST_BYTES) \
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")

    bit = lambda i: F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")
    others = F.array(*[F.array(F.lit(0).cast("long"), *[bit(16 * p + i) for p in range(4) if p not in own for i in range(16)])
                       for own in PAIRS])
    variants = met.where(F.col("n") > most) \
        .select("fp", F.explode(F.element_at(others, F.col("slot") + 1)).alias("flip")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    owners = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where(F.col("a") != F.col("z"))
    stars = variants.join(owners.select("variant", "a"), "variant") \
        .select("a", F.col("fp").alias("b")).where(F.col("a") < F.col("b"))
    return pairs.union(stars).distinct()


def simhash_pairs(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) candidates from (node, fp): each node with the smallest of its fingerprint, and the smallest of
    linked fingerprints. Linear in the nodes."""
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("a")))
    of = lambda side, out: first.select(F.col("fp").alias(side), F.col("a").alias(out))
    linked = links(first.select("fp"), most).join(of("a", "x"), "a").join(of("b", "y"), "b")
    near = linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return near.union(prints.join(first, "fp").select("a", F.col("node").alias("b"))).where("a < b")


def estimates(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b, alike): the similarity that the equal positional bytes of two nodes' (node, sig) tell."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
            alike = ((left == right).mean(1) - 1 / 256) / (1 - 1 / 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["a", "b", "alike"])

    sig = lambda of: named.select(F.col("node").alias(of), F.col("sig").alias(f"sig_{of}"))
    both = pairs.join(sig("b").hint("merge"), "b").join(sig("a").hint("merge"), "a")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(tally, "a long, b long, alike double")


def similar_links(nodes: DataFrame, also: DataFrame, texts: DataFrame, similarity: float, words: int = WORDS, most: int = MOST) -> DataFrame:
    """(a, b) pairs of nodes (node, sig, t1, t2) whose texts reach the similarity, as many as it takes to join all
    that such pairs join. Candidates are the pairs `also`, and pairs whose longer fingerprints `sig` meet in a posting
    list; those go on whose fingerprints share so many bytes that their texts may reach it. All pairs of
    posting lists up to FEW are candidates. In a longer list all members meet the one with most company in long lists, which is in most
    lists of its group, and by that tally are its core (certainly linked to it, so to each other; in a list up to `most` by the wider
    margin), near (a core member may be linked to them) or far. The likeliest one or two of the members that a node met are counted on
    the texts at once, and groups so joined are one from there on: pairs inside a group are asked nowhere, and a list of one group is
    done. Members outside the largest group of a list meet all others, if that makes at most `most` squared pairs or SPLITS a member;
    else the near meet the core, under the same limit, and the core is done. Who still has others to meet goes on to the parts of the list
    that share one of SPLITS further stretches of the fingerprint, which are lists again, until none holds two groups. The
    stretches double in length, so there are at most eight levels. A pair that is in no short list, never met one
    by one and parted at each level is lost.

    The other pairs are counted on the texts last, if their nodes are still in different groups.

    An index entry is written as a hash of its slot and bytes, and only if another node has it: two nodes
    whose hashes agree by chance are one more candidate pair."""
    deviation = math.sqrt(similarity * (1 - similarity) / POSITIONS)
    least, sure = similarity - MARGIN * deviation, similarity + SURE * deviation
    apart = sure - (1 - similarity) - MARGIN * deviation  # shingle distances obey the triangle inequality
    named = nodes.where("sig is not null")
    band = lambda k: F.xxhash64(F.lit(k), F.substring("sig", BAND * k + 1, BAND))
    entries = named.select("node", F.col("node").alias("root"), F.explode(F.array(*[band(k) for k in range(BANDS)])).alias("key"))
    wanted, likely = [also], [also.limit(0).withColumn("alike", F.lit(0.0))]
    roots, sets = named.limit(0).select("node", F.col("node").alias("root")), None
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")).hint("merge")
    rooted = lambda pairs: pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns(
        {f"root_{side}": F.coalesce(f"root_{side}", side) for side in "ab"})
    unjoined = lambda pairs: rooted(pairs).where("root_a != root_b").select(*pairs.columns)
    common = F.min_by("a", F.when(F.col("alike") >= sure, F.xxhash64("a")))
    for level in itertools.count(1):
        lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")) \
            .where("n > 1 and low != high").select("key", "n")
        met = cut(entries.join(lists.hint("merge"), "key"))
        if sets is None:
            sets = shingle_sets(also.union(met.select(F.col("node").alias("a"), F.col("node").alias("b"))), nodes, texts, words)
        short, long_ = met.where(F.col("n") <= min(FEW, most)), met.where(F.col("n") > min(FEW, most))
        one = lambda side: short.select("key", F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        wanted.append(one("a").join(one("b").hint("merge"), "key").where("a < b and root_a != root_b").select("a", "b"))
        if long_.isEmpty():
            break
        # the member with most company: it is in most of a group's lists, and linked to most of the group
        company = long_.withColumn("company", F.sum("n").over(Window.partitionBy("node")))
        firsts = company.groupBy("key").agg(F.max_by("node", F.struct("company", F.xxhash64("node", F.lit(level)))).alias("first"))
        long_ = cut(long_.join(firsts.hint("merge"), "key"))
        stars = cut(estimates(long_.where(F.col("first") != F.col("node")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), named))
        likely.append(stars.where(F.col("alike") >= least).select("a", "b", "alike"))
        trunk = ordered(unjoined(likely[-1]).groupBy("b").agg(F.array_compact(F.array(F.max_by("a", "alike"), common)).alias("of"))
                        .select(F.explode("of").alias("a"), "b")).distinct()
        # only groups are joined to groups, so a level's links are as few as the groups it joins
        groups = rooted(reaching(cut(trunk), sets, similarity)).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        moved = cut(components(cut(groups)))
        onto = moved.select(F.col("node").alias("root"), F.col("root").alias("onto"))
        roots = cut(roots.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root")).union(moved).distinct())
        # null: joined to the member that all have met
        away = F.when(F.col("root_a") != F.col("root_b"), F.col("root_b"))
        told = long_.join(rooted(stars).select(F.col("a").alias("first"), F.col("b").alias("node"), "alike", away.alias("away")).hint("merge"),
                          ["first", "node"], "left")
        certain = F.when(F.col("n") <= most, similarity + MARGIN * deviation).otherwise(sure)
        kind = F.when(F.coalesce("alike", F.lit(1.0)) >= certain, "core").when(F.col("alike") >= apart, "near").otherwise("far")
        told = cut(told.select("key", "node", kind.alias("kind"), F.when(kind != "core", F.col("away")).alias("away")))
        sizes = told.groupBy("key", "away").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("kind") == "near") & F.col("away").isNotNull()).alias("near")) \
            .groupBy("key").agg(F.max_by("away", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.sum("near").alias("near"), F.sum("n").alias("n")) \
            .where("others > 0")
        open_ = cut(told.join(sizes.hint("merge"), "key"))
        core = F.col("kind") == "core"
        few, few_near = ((F.col(c) * F.col("n") <= most * most) | (F.col(c) <= SPLITS) for c in ("others", "near"))
        asking = F.when(few, ~F.col("away").eqNullSafe(F.col("main"))).otherwise(few_near & (F.col("kind") == "near") & F.col("away").isNotNull())
        asks = open_.where(asking).select("key", F.col("node").alias("x"), F.col("away").alias("away_x"))
        asked = open_.where(few | few_near & core).select("key", F.col("node").alias("y"), F.col("away").alias("away_y"), asking.alias("too"))
        wanted.append(asked.join(asks.hint("merge"), "key").where(((F.col("x") < F.col("y")) | ~F.col("too")) & ~F.col("away_x").eqNullSafe(F.col("away_y")))
                      .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        # twice as many positions at each level; the last takes all, and members of one signature are core
        width = min(POSITIONS, BAND << level - 1)
        place = lambda s: F.pmod(F.xxhash64("key", F.lit(s)), F.lit(POSITIONS)).cast("int") + 1
        finer = F.array(*[F.xxhash64("key", F.substring(F.concat("sig", "sig"), place(s), F.lit(width))) for s in range(SPLITS)])
        parted = open_.where(~few & (~few_near | ~core)).select("key", "node").join(named.select("node", "sig").hint("merge"), "node") \
            .join(roots.hint("merge"), "node", "left")
        # read twice, by the sizes of the lists and by their members
        entries = cut(parted.select("node", F.coalesce("root", "node").alias("root"), F.explode(finer).alias("key")).distinct())
    wanted, likely = (cut(functools.reduce(DataFrame.union, some).distinct()) for some in (wanted, likely))
    others = estimates(unjoined(wanted), named).where(F.col("alike") >= least).select("a", "b")
    left = cut(unjoined(ordered(likely)).union(others).distinct())
    return roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(reaching(left, sets, similarity))


def shingle_sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, hashes): the different shingles of the nodes of pairs (a, b). A node's text is the one of texts (text,
    t1, t2) with its hashes in nodes (node, t1, t2); only texts of pairs are read into shingles, equal texts once."""
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.select("node", "t1", "t2").join(met, "node", "left_semi"))
    # a shuffle of the texts at any size: a broadcast of the wanted nodes would hold only while they are few
    once = texts.join(wanted.hint("merge"), ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    hashes = lambda some: [distinct_shingles(t, words) for t in some]
    return cut(annotate(once, "text", "hashes", T.ArrayType(T.LongType()), hashes).select("node", "hashes"))


def reaching(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose nodes' sets (node, hashes) reach the similarity, by counting the shared shingles."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("hashes").alias(f"of_{side}"))
    met = with_held(pairs.join(of("b").hint("merge"), "b").join(of("a").hint("merge"), "a"), {"shared": F.size(F.array_intersect("of_a", "of_b"))})
    return met.where(F.col("shared") / (F.size("of_a") + F.size("of_b") - F.col("shared")) >= similarity).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node it reaches. Alternates the
    two star rewritings, which keep connectivity and end in stars; each round is a written table."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        moved = joined.where(F.col("b") > F.col("a")) if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    mark = None
    while True:
        edges = cut(star(star(edges, True), False))
        # the sum wraps, it only marks a change
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).collect()[0]
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST,
            keep: list[str] | None = None, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: the columns `keep` (the id by default), `fp` (long), `component`, the
    smallest doc_id among all documents reachable over links of at most two differing bits, itself
    included, and `root`, the component's smallest fingerprint. With a `similarity`, the links are those of
    documents whose shingle sets reach it and no others, fingerprints only name candidates, equal sets are
    one, and `root` is the component's smallest set hash. Null and empty
    texts have fingerprint zero and link by it like any other (with a `similarity`: by their empty set); a null doc_id never is a component's id unless the component has no other. Repeated rows and copies share a fingerprint and
    are indexed once; an empty table gives an empty result. Texts and extra columns are left behind
    after the fingerprint, so clashing names do not matter; texts are read again only to count the shared
    shingles of likely pairs."""
    keep = keep or [doc_id]
    columns = [docs[c] for c in dict.fromkeys([*keep, doc_id, text])]
    plain = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    of = dict(zip(dict.fromkeys([*keep, doc_id, text]), plain.columns))
    key, sigs = "fp", []
    if similarity is None:
        printed = fingerprints(plain, of[text], "fp", words)
    else:
        key, sigs = "node", ["sig", "t1", "t2"]
        kind = T.StructType([T.StructField("fp", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("node", T.LongType())])
        # one pass: each pass of a stage holds a Python worker and a copy of the batch for every task
        printed = annotate(plain, of[text], "sketch", kind, lambda texts: [sketch(t, words) for t in texts])
        printed = printed.withColumns({f"t{i}": F.xxhash64(F.lit(i), of[text]) for i in (1, 2)} | {c: F.col(f"sketch.{c}") for c in kind.names})
    marked = cut(printed.select(*dict.fromkeys(["fp", key]), *sigs, *dict.fromkeys([of[doc_id], *[of[c] for c in keep]])))
    one = [F.min(F.struct(*sigs)).alias("one")] if sigs else []
    ids = cut(marked.groupBy(key).agg(F.min(of[doc_id]).alias("low"), *one).select(key, "low", *[f"one.{c}" for c in sigs]))
    if similarity is None:
        edges = links(ids.select("fp"), most)
    else:
        texts = plain.select(F.col(of[text]).alias("text"), *[F.xxhash64(F.lit(i), of[text]).alias(f"t{i}") for i in (1, 2)])
        also = simhash_pairs(cut(marked.select("node", "fp").distinct()), most)
        edges = similar_links(ids, also, texts, similarity, words, most)
    roots = components(cut(edges))
    rooted = ids.join(roots.withColumnRenamed("node", key), key, "left") \
        .select(key, "low", F.coalesce("root", key).alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.select(key, "root").join(lows, "root").select(key, "component", "root")
    return marked.join(named, key).select(*[F.col(of[c]).alias(c) for c in keep], "fp", "component", "root")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    similarity: float | None = None) -> DataFrame:
    """One document of each component with the columns of docs as they were: the smallest doc_id, ids
    before null, then the smallest hash of the row; equal rows stay once. A document is known by a
    128-bit hash of all its columns, so null or repeated ids lose no document of another component."""
    row = [F.col(c) for c in docs.columns]
    r1, r2 = fresh(docs, "row1"), fresh(docs, "row2")
    marked = docs.withColumns({r1: F.xxhash64(F.lit(1), *row), r2: F.xxhash64(F.lit(2), *row)})
    near = cluster(marked, doc_id, text, words, keep=[doc_id, r1, r2], similarity=similarity)
    first = F.min(F.struct(F.col(doc_id).isNull(), doc_id, r1, r2)).alias("first")
    kept = near.groupBy("root").agg(first) \
        .select(F.col(f"first.{r1}").alias(r1), F.col(f"first.{r2}").alias(r2))
    once = marked.withColumn(fresh(marked, "rank"), F.row_number().over(Window.partitionBy(r1, r2).orderBy(r1)))
    once = once.where(F.col(once.columns[-1]) == 1)
    return once.join(kept, [r1, r2], "left_semi").select(*docs.columns)
