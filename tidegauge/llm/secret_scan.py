"""Secrets in texts: fixed patterns, and candidate strings with a window of high entropy.

A candidate is a long run of token characters. It belongs to a character class (hexadecimal, letters and
digits of one case, or the full set), and a window slides over it: the counts of the class's characters
in the window change by one entering and one leaving character, and with them the sum of c log2 c from
which the Shannon entropy follows. The highest window decides against the class's threshold; an allow
list suppresses what is no secret. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import fresh, text_of, with_held

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 or more characters: no later match hides in a shorter run
HEX = r"[0-9a-f]{32,}"
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20


@dataclass(frozen=True)
class CharacterClass:
    """A pattern for whole candidates, the alphabet that is counted, and the least entropy in bits."""

    name: str
    pattern: str
    alphabet: str
    least: float


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Tried in this order. A window of random characters has about 3.4, 3.9 and 4.1 bits.
CLASSES = (
    CharacterClass("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdefABCDEF", 3.0),
    CharacterClass("one_case", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER + UPPER, 3.6),
    CharacterClass("full", "", DIGITS + LOWER + UPPER + "+/_=-", 3.8),
)
#: What looks random and is no secret: words, numbers, identifiers, paths, names of constants, samples.
ALLOW = (
    r"^[A-Za-z_/=+-]+$",
    r"^[0-9_/=+-]+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]+([_/-][A-Za-z]+)*[_/-]?[0-9]{1,4}$",
    r"^([a-z0-9]{1,12}[_/-])+[a-z0-9]{1,12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|0123456789|abcdefgh|x{6,}",
)
PART = 256


NONE = "cast(array() as array<struct<start:bigint,end:bigint>>)"


def measured(text: Column, found: Column, pattern: str) -> Column:
    """For each match the length of the piece before it and its own."""
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("long"))))


def located(lengths: Column) -> Column:
    """The spans (start, end) of matches from their measured lengths, in order; null gives none. Lengths
    are summed in parts, so that long lists stay near linear."""
    none = F.expr(NONE)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        return F.struct((start + x["long"]).alias("at"), F.concat(
            state["spans"], F.array(F.struct(start.alias("start"), (start + x["long"]).alias("end")))).alias("spans"))

    def chunk(state: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(lengths, i, F.lit(PART)), F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return F.transform(F.array(inner), lambda got: F.struct(
            got["at"].alias("at"), F.concat(state["spans"], got["spans"]).alias("spans")))[0]

    spans = F.aggregate(F.sequence(F.lit(1), F.size(lengths), F.lit(PART)),
                        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), chunk)["spans"]
    return F.when(F.size(lengths) > 0, spans).otherwise(none)


def entropy(candidate: Column, kind: CharacterClass, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of a window over the candidate, in bits, by incremental counts."""
    places = F.transform(F.split(candidate, ""), lambda c: F.call_function("locate", c, F.lit(kind.alphabet)))
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    f = lambda c: F.element_at(weight, c + 1)
    zero = F.array_repeat(F.lit(0), len(kind.alphabet))

    def step(state: Column, place: Column) -> Column:
        leaving = F.when(state["i"] >= window, F.element_at(places, F.greatest(state["i"] - window + 1, F.lit(1)))).otherwise(0)
        old = F.when(leaving > 0, F.element_at(state["counts"], F.greatest(leaving, F.lit(1)))).otherwise(0)
        less = F.when(leaving > 0, f(old - 1) - f(old)).otherwise(0.0)
        now = F.element_at(state["counts"], place) - F.when(leaving == place, 1).otherwise(0)
        total = state["sum"] + less + f(now + 1) - f(now)
        counts = F.transform(state["counts"], lambda v, i: v + F.when(i + 1 == place, 1).otherwise(0) - F.when(i + 1 == leaving, 1).otherwise(0))
        bits = F.when(state["i"] >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(0.0)
        return F.struct((state["i"] + 1).alias("i"), counts.alias("counts"), total.alias("sum"),
                        F.greatest(state["best"], bits).alias("best"))

    start = F.struct(F.lit(0).alias("i"), zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(places, start, step)["best"]


def is_secret(candidate: Column, classes: tuple = CLASSES, allow: tuple = ALLOW) -> Column:
    """Whether a candidate passes the allow list and its class's threshold."""
    verdict = None
    for kind in classes:
        test = entropy(candidate, kind) >= kind.least
        if not kind.pattern:
            verdict = test if verdict is None else verdict.otherwise(test)
        else:
            own = candidate.rlike(kind.pattern)
            verdict = F.when(own, test) if verdict is None else verdict.when(own, test)
    for pattern in reversed(allow):
        verdict = F.when(candidate.rlike(pattern), F.lit(False)).otherwise(verdict)
    return verdict


def scan(docs: DataFrame, text: str = "text", out: str = "secrets", classes: tuple = CLASSES, allow: tuple = ALLOW) -> DataFrame:
    """docs with a column `out`: spans (kind, start, end in code points), by start and then by kind as
    listed. Spans of the fixed patterns always stay; an entropy span is added where it overlaps none of
    them. Null and empty texts have none, long texts are read whole, repeated rows repeat, an empty table
    stays empty, all other columns stay, whatever their names."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    t, fixed = fresh(docs, "t"), fresh(docs, "fixed")
    found, lengths = ({k: fresh(docs, f"{what}_{k}") for k in KINDS} for what in ("found", "lengths"))
    df = with_held(docs.withColumn(t, text_of(docs, text)),
                   {found[k]: F.regexp_extract_all(F.col(t), F.lit(patterns[k]), F.lit(0)) for k in KINDS})
    worth = {k: F.exists(F.col(found[k]), lambda c: is_secret(c, classes, allow)) if k == "entropy" else F.size(found[k]) > 0 for k in KINDS}
    df = with_held(df, {lengths[k]: F.when(worth[k], measured(F.col(t), F.col(found[k]), patterns[k])) for k in KINDS})

    def named(kind: str, ok=None) -> Column:
        both = F.zip_with(located(F.col(lengths[kind])), F.when(F.col(lengths[kind]).isNotNull(), F.col(found[kind])).otherwise(
            F.expr("cast(array() as array<string>)")), lambda s, m: F.struct(s["start"].alias("start"), s["end"].alias("end"), m.alias("m")))
        return F.transform(F.filter(both, lambda x: ok(x["m"])) if ok else both, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    whole = named("assign", lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= 8)
    df = with_held(df, {fixed: F.concat(whole, named("access"), named("hex"))})
    added = F.filter(named("entropy", lambda m: is_secret(m, classes, allow)),
                     lambda a: ~F.exists(F.col(fixed), lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    spans = F.transform(F.array_sort(F.concat(F.col(fixed), added)), lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return with_held(df, {out: spans}).drop(t, fixed, *found.values(), *lengths.values())


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by the mask; overlapping spans become one. A null text
    stays null, a text without secrets stays as it is; all columns keep their names and order."""
    found = fresh(docs, "secrets")
    df = scan(docs, text, found)
    state = F.aggregate(F.col(found), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda s, x: F.when(
        x["start"] >= s["at"], F.struct(F.greatest(x["end"], s["at"]).alias("at"), F.concat(s["out"], F.substring(
            F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask)).alias("out")))
        .otherwise(F.struct(F.greatest(x["end"], s["at"]).alias("at"), s["out"].alias("out"))))
    rebuilt = F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(text)))
    return df.withColumn(text, F.when(F.size(found) > 0, rebuilt).otherwise(F.col(text))).select(*docs.columns)
