"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and the acceptor again.

Two words are near if one inserted, deleted or replaced code point leads from one to the other. A pair is
handled in the class of the longer word's length c, so each word takes part in the classes of its own length
and of the next. Within a class the place of the edit (the length of the common prefix) lies in one of the
windows [a, b): both words then share their first a and their last c - b code points. Such a pair of strings
is the initial state of a partition of the composition: one partition holds the middles of the words that
share it, as minimised acceptors of the long and of the short words, and the accepted pairs of
acceptor o edit o acceptor are enumerated there.

A class starts with two windows, its halves. A partition of more than MOST words is not composed: its words
come back and are partitioned anew with windows half as wide. In a window of one code point at most one word
a letter of the alphabet and one short word can meet, so this ends, and no word is left out.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut

#: Least code points and occurrences of a word, how many times as frequent its form is, and what h is divided by.
LEAST, OCCURS, TIMES, DROPS = 7, 2, 10, 31
#: Words composed in one partition, words counted at once in a task, and bytes of text split at once.
MOST, HELD, PIECE = 2048, 1 << 19, 1 << 22
#: What a byte of Latin-1 text becomes: A-Z their lower case, other letters themselves, all else a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


# ---- words -----------------------------------------------------------------------------------------------

def runs(text: str) -> Iterator[list[bytes]]:
    """The runs of letters as Latin-1 bytes, lower case, in lists of bounded size; code points above 0xFF
    are no letters here."""
    raw = text.encode("latin-1", "replace").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def spelled(doc: str, run: bytes) -> bytes:
    """The run as this document spells it: where 31 divides its hash, one code point is missing."""
    plain = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(plain, zlib.crc32(f"{doc}:".encode()))
    if h % DROPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST code points with at least OCCURS occurrences in all texts. Each
    task adds up its own words before they are shuffled. A null id is written as nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                               pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in runs(body or ""):
                    for run, n in Counter(w for w in part if len(w) >= LEAST).items():
                        word = spelled("" if doc is None else doc, run)
                        if len(word) >= LEAST:
                            held[word] += n
                    if len(held) > HELD:
                        yield rows()
                        held.clear()
        yield rows()

    counted = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("body")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURS)


# ---- acceptors and their composition ---------------------------------------------------------------------

class Acceptor:
    """Minimised acceptor of words of one length. A state is a tuple of arcs (label, state) with different
    first letters, chains without a branch being one arc; states with equal right languages are one object."""

    def __init__(self, register: dict, words: list[str]):
        self.register = register
        self.start = self._build(sorted(words), 0) if words else None

    def _build(self, words: list[str], depth: int) -> tuple:
        if depth == len(words[0]):
            return ()
        arcs, at = [], 0
        while at < len(words):
            letter, end = words[at][depth], at + 1
            while end < len(words) and words[end][depth] == letter:
                end += 1
            stop = shared(words[at], words[end - 1], depth)
            arcs.append((words[at][depth:stop], self._build(words[at:end], stop)))
            at = end
        return self.register.setdefault(tuple(arcs), tuple(arcs))


def shared(a: str, b: str, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree before `at`."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    while a[at] == b[at]:
        at += 1
    return at


def after(label: str, state: tuple) -> tuple:
    """The state behind the first letter of an arc."""
    return ((label[1:], state),) if len(label) > 1 else state


def language(state: tuple) -> Iterator[str]:
    if not state:
        yield ""
    for label, to in state:
        for rest in language(to):
            yield label + rest


def common(p: tuple, q: tuple) -> Iterator[str]:
    """The strings accepted from both states, which have equally long ones."""
    if p is q or p == q:
        yield from language(p)
        return
    of = {label[0]: (label, to) for label, to in q}
    for left, to_left in p:
        if left[0] not in of:
            continue
        right, to_right = of[left[0]]
        k = shared(left, right)
        if k == len(left) or k == len(right):
            on_left = ((left[k:], to_left),) if k < len(left) else to_left
            on_right = ((right[k:], to_right),) if k < len(right) else to_right
            for rest in common(on_left, on_right):
                yield left[:k] + rest


def replaced(p: tuple, before: str = "") -> Iterator[tuple[str, str]]:
    """Pairs of the acceptor's words with one letter replaced."""
    for i, (left, to_left) in enumerate(p):
        for right, to_right in p[i + 1:]:
            for rest in common(after(left, to_left), after(right, to_right)):
                yield before + left[0] + rest, before + right[0] + rest
    for label, to in p:
        if to:
            yield from replaced(to, before + label)


def inserted(p: tuple, q: tuple, follows: str, before: str = "") -> Iterator[tuple[str, str]]:
    """Pairs of a word from p and a word from q that has one letter more, where they first differ; `follows`
    is the letter behind the words of p."""
    for label, to in q:
        rest_of = after(label, to)
        if not p:
            if label[0] != follows:
                yield before, before + label[0]
            continue
        for rest in common(tuple(a for a in p if a[0][0] != label[0]), rest_of):
            yield before + rest, before + label[0] + rest
    of = {label[0]: (label, to) for label, to in q}
    for left, to_left in p:
        if left[0] in of:
            right, to_right = of[left[0]]
            k = shared(left, right)
            yield from inserted(((left[k:], to_left),) if k < len(left) else to_left,
                                ((right[k:], to_right),) if k < len(right) else to_right, follows, before + left[:k])


def composed(words: dict[str, int], size: int, a: int, b: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, occurrences and name of the best) of a partition: `words` with their occurrences, of
    `size` or one code point less, that agree before a and in the last size - b."""
    if len(words) < 2:
        return []
    some = next(iter(words))
    head, tail = some[:a], some[len(some) - (size - b):]
    middles: tuple[list, list] = ([], [])
    for word in words:
        middles[len(word) == size].append(word[a:len(word) - len(tail)])
    register: dict = {}
    short, long_ = (Acceptor(register, m).start for m in middles)
    number, best = Counter(), {}

    def meet(left: str, right: str) -> None:
        for word, other in ((head + left + tail, head + right + tail), (head + right + tail, head + left + tail)):
            number[word] += 1
            found = (-words[other], other)
            if word not in best or found < best[word]:
                best[word] = found

    if long_ is not None:
        for pair in replaced(long_):
            meet(*pair)
        if short is not None:
            for pair in inserted(short, long_, tail[:1]):
                meet(*pair)
    return [(word, n, -best[word][0], best[word][1]) for word, n in number.items()]


# ---- partitions --------------------------------------------------------------------------------------------

FOUND = "word string, near long, best_n long, best string, n long, size int, a int, b int"


def initial_states(words: DataFrame) -> DataFrame:
    """(word, n, size, a, b, state): each word in both windows of both its classes."""
    size = F.length("word")
    entries = []
    for more in (0, 1):
        c = size + more
        half = F.floor(c / 2).cast("int")
        entries += [F.struct(c.alias("size"), F.lit(0).alias("a"), half.alias("b")), F.struct(c.alias("size"), half.alias("a"), c.alias("b"))]
    return with_state(words.select("word", "n", F.inline(F.array(*entries)).alias("size", "a", "b")))


def with_state(entries: DataFrame) -> DataFrame:
    """The strings that the words of a partition share: before a, and the last size - b."""
    tail = F.col("size") - F.col("b")
    shared_part = F.concat_ws("|", F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - tail + 1, tail))
    return entries.withColumn("state", shared_part)


def halved(left: DataFrame) -> DataFrame:
    """The words of partitions that were too large, in windows half as wide."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    return with_state(left.select("word", "n", "size", F.inline(F.array(
        F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))).alias("a", "b")))


def compose(entries: DataFrame, most: int = MOST) -> DataFrame:
    """The partitions' results: rows with `near` for words that have near ones, and rows with `n` for the words
    of partitions above `most`, which are to be partitioned anew."""
    by = ["size", "a", "b", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * most + 1000))  # staircases of words nest as deep as there are words
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*out) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              [f.split()[0] for f in FOUND.split(", ")])

        def close() -> None:
            if key is None or too_many:
                return
            out.extend((*row, None, None, None, None) for row in composed(words, *key[:3]))

        def back(word: str, n: int) -> None:
            out.append((word, None, None, None, n, *key[:3]))

        key, words, too_many = None, {}, False
        for batch in batches:
            for *state, word, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if state != key:
                    close()
                    key, words, too_many = state, {}, False
                if too_many:
                    back(word, n)
                else:
                    words[word] = n
                    if len(words) > most and key[2] - key[1] > 1:
                        too_many = True
                        for item in words.items():
                            back(*item)
                        words = {}
                if len(out) > 1 << 14:
                    yield batch_of()
                    out.clear()
        close()
        yield batch_of()

    return entries.select(*by, "word", "n").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, FOUND)


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the most frequent
    (ties: the smallest in code-point order)."""
    spark, entries, parts = words.sparkSession, initial_states(words), []
    while True:
        found = cut(compose(entries, most))
        parts.append(found.where("near is not null").select("word", "near", "best_n", "best"))
        left = found.where("n is not null").select("word", "n", "size", "a", "b")
        if left.isEmpty():
            break
        entries = halved(left)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("name"))).alias("first")
    return whole.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.name").alias("best"))


def rooted(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without a cycle: forms are followed in steps that double."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        now = moved.select("word", "root")
        if moved.where("next is not null").isEmpty():
            return now


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary of docs: its occurrences, the number
    of its near words, its form (the most frequent near word if that is at least `times` as frequent, else
    null) and the word reached over forms. Null and empty texts have no words, repeated rows count each, very
    long texts and words are taken whole, equal frequencies go to the smaller word, a null id is written as
    nothing before the colon; other columns of docs, whatever their names, are not read; an empty table gives
    an empty result."""
    words = cut(vocabulary(docs, doc_id, text))
    best = words.join(near_words(words, most), "word", "left")
    above = F.col("best_n") >= F.lit(times) * F.col("n")
    named = cut(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(above, F.col("best")).alias("form"), F.when(above, F.col("best_n")).alias("form_n")))
    roots = rooted(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
