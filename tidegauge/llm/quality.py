"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a document. On a sample every rule's run time and share of
rejections are measured, the rules are put in the order of rejections per cost, and a document is tested
in that order until the first rejection. The verdict does not depend on the order, only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import BLANKS, SPACE, fresh, sampled, text_of, with_held
from tidegauge.session import cut

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents on which costs and rejections are measured, about; evaluations of a rule on each, and runs of
#: which the fastest counts.
SAMPLE, REPEATS, RUNS = 2000, 8, 2
#: Low bits of a window's key that hold its place.
PLACE_BITS = 21


@dataclass(frozen=True)
class Rule:
    """A name and the condition, over text, words and counts, under which a document is rejected."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


#: Conditions of their own beside the two fixed ones; each looks at the whole text.
RULES = (
    Rule("symbols", lambda c: share(c["n_symbols"], c["n_words"]) > 0.1),
    Rule("dup_lines", lambda c: share(c["n_dup_lines"], F.size(F.split(c["text"], "\n"))) > 0.3),
    Rule("word_length", lambda c: ~share(c["word_chars"], c["n_words"]).between(2.0, 12.0)),
    Rule("shouting", lambda c: share(F.regexp_count(c["text"], F.lit("[A-Z]{2,}")), c["n_words"]) > 0.5),
    Rule("exclamations", lambda c: share(F.regexp_count(c["text"], F.lit("!")), c["n_words"]) > 0.2),
    Rule("few_letters", lambda c: share(F.regexp_count(c["text"], F.lit(rf"(?<![^{SPACE}])[^\p{{L}}{SPACE}]+(?![^{SPACE}])")), c["n_words"]) > 0.3),
    Rule("one_word", lambda c: share(c["n_words"] - F.size(F.array_distinct(c["words"])), c["n_words"]) > 0.9),
)


def covered(starts: Column) -> Column:
    """How many places the three-word windows at `starts` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def window_pairs(keys: Column) -> Column:
    """(a, b) places of windows that stand side by side in the sorted `keys` and have one hash."""
    at = F.filter(F.sequence(F.lit(0), F.size(keys) - 2), lambda i: F.shiftrightunsigned(
        F.get(keys, i).bitwiseXOR(F.get(keys, i + 1)), PLACE_BITS) == 0)
    place = lambda i: F.get(keys, i).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return F.transform(at, lambda i: F.struct(place(i).alias("a"), place(i + 1).alias("b")))


def window(words: Column, i: Column) -> Column:
    """The three words from place i; no word holds a blank, so equal strings are equal windows."""
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def repeated_words(words: Column, pairs: Column) -> Column:
    """Words in three-word windows found twice or more, from the pairs of one hash. If any pair differs in
    its words, unlike windows share a hash: then the windows of all pairs are sorted by their words."""
    places = F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))
    by_words = F.array_sort(F.transform(F.array_distinct(places), lambda i: F.struct(window(words, i).alias("h"), i.alias("i"))))
    exact = F.transform(F.array(by_words), long_repeated_words)[0]  # bound once, not anew for each place
    unlike = F.exists(pairs, lambda p: window(words, p["a"]) != window(words, p["b"]))
    return F.when(unlike, exact).otherwise(covered(places))


def long_windows(words: Column) -> Column:
    """For texts of more words than a key can place: windows as (hash, words, place), sorted."""
    return F.array_sort(F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda x, i: F.struct(F.struct(
        F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("hash"), window(words, i).alias("words")).alias("h"), i.alias("i"))))


def long_repeated_words(windows: Column) -> Column:
    """The same from windows sorted by `h`, their name, with their place `i`."""
    same = F.filter(F.sequence(F.lit(0), F.size(windows) - 2), lambda i: F.get(windows, i)["h"] == F.get(windows, i + 1)["h"])
    return covered(F.flatten(F.transform(same, lambda i: F.array(F.get(windows, i)["i"], F.get(windows, i + 1)["i"]))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more struct column `facts`: the text (null as empty), its words, and n_words,
    word_chars, n_symbols, n_dup_lines and n_repeat_words. A window of three words is one 64-bit number
    of hash and place, so that a sort of plain numbers brings equal windows together."""
    out, words, keys, pairs, windows, lines = (fresh(docs, name) for name in ("facts", "words", "keys", "pairs", "windows", "lines"))
    t = text_of(docs, text)
    bare = F.call_function("btrim", t, F.lit(BLANKS))
    df = with_held(docs, {words: F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, f"[{SPACE}]+")),
                           lines: F.filter(F.split(t, "\n"), lambda line: F.call_function("btrim", line, F.lit(BLANKS)) != "")})
    w, n = F.col(words), F.size(words)
    short = (n > 3) & (n < 1 << PLACE_BITS)
    made = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
                       .bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long")))
    df = with_held(df, {keys: F.when(short, F.sort_array(made)), windows: F.when((n > 3) & ~short, long_windows(w))})
    df = with_held(df, {pairs: F.when(short, window_pairs(F.col(keys)))})
    repeated = F.when(short, repeated_words(w, F.col(pairs))).when(n > 3, long_repeated_words(F.col(windows))).otherwise(0)
    return with_held(df, {out: F.struct(
        t.alias("text"), w.alias("words"), n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"))}).drop(words, keys, pairs, windows, lines)


FACTS = ("text", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def facts(column: str) -> dict[str, Column]:
    return {name: F.col(f"{column}.{name}") for name in FACTS}


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def ordered(docs: DataFrame, text: str = "text", rules: tuple = RULES, sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per cost, with the measured seconds and rejected share. Measured on the
    documents of the sample that pass the fixed rules; without any, the rules keep their order."""
    plain = docs.select(F.col(text).alias("text"))
    some = measured(sampled(plain.where(F.col("text").isNotNull()), ["text"], sample))
    some = cut(some.where(~base_failed(facts("facts"))).select("facts"))
    timed(some, facts("facts")["n_words"] > 0)  # the first job also opens the files
    least, out = timed(some, facts("facts")["n_words"] > 0)[0], []
    for rule in rules:
        took, rejected = timed(some, rule.rejects(facts("facts")))
        out.append((rule, max(took - least, 1e-2), rejected))  # below, rules cost alike: next to nothing
    return sorted(out, key=lambda x: -(x[2] / x[1]))


def timed(df: DataFrame, condition: Column) -> tuple[float, float]:
    """Seconds that one task takes for REPEATS evaluations on every row, and the share of true ones. The
    evaluations stand in a lambda function, which runs anew for each element."""
    every = F.aggregate(F.sequence(F.lit(1), F.lit(REPEATS)), F.lit(0.0), lambda n, _: n + F.when(condition, 1.0).otherwise(0.0))
    took, share_ = [], None
    for _ in range(RUNS):
        began = time.perf_counter()
        share_ = df.coalesce(1).agg(F.avg(every / REPEATS)).collect()[0][0]
        took.append(time.perf_counter() - began)
    return min(took), share_ or 0.0


def judge(docs: DataFrame, text: str = "text", out: str = "quality", rules: tuple = RULES, sample: int = SAMPLE) -> DataFrame:
    """docs with a struct column `out`: the counts, `base_failed`, `kept`, and `rejected_by`, the first rule
    in cascade order that rejects (null if kept or failed by a fixed rule). A null or empty text has no
    words and fails; texts are read whole; repeated rows repeat; an empty table stays empty; other columns
    stay, whatever their names."""
    cascade = [rule for rule, _, _ in ordered(docs, text, rules, sample)]
    df = measured(docs, text)
    name = df.columns[-1]
    c = facts(name)
    failed, verdict = base_failed(c), None
    for rule in cascade:
        hit, label = rule.rejects(c), F.lit(rule.name)
        verdict = F.when(hit, label) if verdict is None else verdict.when(hit, label)
    by = F.when(~failed, verdict)
    rejected = fresh(df, "rejected")
    df = df.withColumn(rejected, by)
    made = F.struct(*[c[f] for f in FACTS[2:]], failed.alias("base_failed"),
                    (~failed & F.col(rejected).isNull()).alias("kept"), F.col(rejected).alias("rejected_by"))
    return df.withColumn(rejected, made).drop(name).withColumnRenamed(rejected, out)
