"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: the four strict patterns and looser ones (spelled-out
addresses, bracketed dots, local telephone numbers, card numbers with unusual separators). Boosted trees
score each candidate by its format and context; thresholds calibrated per kind on held-out rows select
the spans. Spans of the strict patterns that pass their check always stay.

The trees learn from a bounded sample of the documents: strict spans are positive, also rewritten in the
looser formats; strict matches that fail their check, spans with altered digits, and loose candidates
without a cue word nearby are negative.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import annotate, sampled

KINDS = ("email", "ip", "card", "phone")
#: Documents that the trees learn from, about, and the most candidates kept of them.
SAMPLE, ROWS = 8000, 40_000
#: Trees, depth, learning rate, quantile bins; precision that a threshold must reach on held-out rows.
TREES, DEPTH, RATE, BINS, PRECISION = 40, 3, 0.3, 32, 0.99
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
                     T.StructField("score", T.DoubleType())])

# The strict patterns, written so that no text takes quadratic time: an address is found at its @, and a
# number is entered at its first digit only.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The loose ones; every repetition is bounded.
SPELLED_AT = {at: re.compile(re.escape(at) + r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{2,24}){1,4}")
              for at in (" at ", "(at)", "[at]", "{at}", "@")}
DIGIT = re.compile("[0-9]")
BRACKETED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![0-9])")
SEPARATED = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/:][0-9]{2,6}){2,4}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
CUES = {
    "email": re.compile(r"e-?mail|mail|contact|write to|reach", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|client", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|payment|iban|account", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|cell|whatsapp", re.I),
}
AROUND = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of each leftmost non-overlapping strict match, by kind."""
    last = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end(), True
            last = m.end()
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        n = len(d) if m.end() - m.start() <= 40 and (d := digits_of(m[0])) else 99
        if n > 6:  # shorter ones are never candidates
            yield "card", m.start(), m.end(), 13 <= n <= 19 and luhn(d)
    for m in PHONE.finditer(text) if "+" in text else ():
        yield "phone", m.start(), m.end(), 9 <= (len(digits_of(m[0])) if m.end() - m.start() <= 4096 else len(re.findall("[0-9]", m[0]))) <= 15


def loose(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates of the high-recall generators; they may overlap others."""
    for at, pattern in SPELLED_AT.items():
        for m in pattern.finditer(text) if at in text else ():
            stop = m.start() - (text[m.start() - 1:m.start()] == " ")
            start = stop
            while start and stop - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < stop:
                yield "email", start, m.end()
    if DIGIT.search(text):
        for kind, pattern in (("ip", BRACKETED), ("card", SEPARATED), ("phone", LOCAL_PHONE)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    digits, groups = digits_of(span), re.findall("[0-9]+", span)
    letters = sum(c.isalpha() for c in span)
    tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
    return [
        KINDS.index(kind), len(span), len(digits), letters, len(span) - len(digits) - letters, len(set(digits)), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        luhn(digits) if digits else 0, max((int(g[:6]) for g in groups), default=0) > 255, span.count("."), span.count("-"),
        span.count(" "), "(" in span or "[" in span or "{" in span, "@" in span, len(tail) if tail.isalpha() else 0,
        bool(CUES[kind].search(before)), bool(CUES[kind].search(after)), sum("0" <= c <= "9" for c in before + after),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ".,/-_" and before != "", after[:1] in "/-_@" and after != "",
    ]


def context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - AROUND):start], text[end:end + AROUND]


def rewritten(kind: str, span: str) -> str | None:
    """A span of a strict pattern as it looks in the looser format of its kind."""
    if kind == "email":
        return span.replace("@", " at ").replace(".", " dot ")
    if kind == "ip":
        return span.replace(".", "[.]")
    digits = digits_of(span)
    if kind == "card":
        return ".".join(re.findall("[0-9]{1,4}", digits)) if len(digits) >= 14 else None
    return f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}" if len(digits) >= 10 else None


def altered(kind: str, span: str, seed: int) -> str:
    """A span that looks alike but is broken: a digit moved on, or an address without its domain."""
    rng = random.Random(seed)
    if kind == "email":
        return re.split("@", span)[0] + " at " + rng.choice(("the", "an", "all", "last", "noon")) + " " + str(rng.randrange(10, 99))
    places = [i for i, c in enumerate(span) if "0" <= c <= "9"]
    if kind == "ip":
        return span[:places[0]] + "9" + span[places[0]:] if rng.random() < 0.5 else span + "." + str(rng.randrange(99))
    if kind == "phone":
        return span[1:places[len(places) // 2]]
    i = rng.choice(places)
    return span[:i] + str((int(span[i]) + 1) % 10) + span[i + 1:]


def labelled(text: str | None) -> list[list[float]]:
    """Rows of label and features that one document teaches."""
    if not text:
        return []
    rows, taken = [], []
    for kind, start, end, ok in strict(text):
        span, (before, after) = text[start:end][:256], context(text, start, end)
        rows.append([float(ok), *features(kind, span, before, after)])
        if ok:
            taken.append((start, end))
            if other := rewritten(kind, span):
                rows.append([1.0, *features(kind, other, before, after)])
            for seed in (start, start + 1):
                rows.append([0.0, *features(kind, altered(kind, span, seed), before, after)])
    for kind, start, end in loose(text):
        before, after = context(text, start, end)
        if not CUES[kind].search(before) and not any(s < end and start < e for s, e in taken):
            rows.append([0.0, *features(kind, text[start:end], before, after)])
    return [[float(x) for x in r] for r in rows]


class Trees:
    """Gradient-boosted trees for a binary label: depth DEPTH, Newton leaf values, quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees, margin = [], np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += self._apply(tree, binned)

    def _grow(self, binned, g, h):
        node, splits = np.zeros(len(g), int), []
        for level in range(DEPTH):
            column, edge = np.zeros(2**level, int), np.full(2**level, 1 << 30)
            best = np.full(2**level, 1e-6)
            for j in range(binned.shape[1]):
                width = len(self.cuts[j]) + 1
                at = node * width + binned[:, j]
                sums = [np.bincount(at, w, 2**level * width).reshape(-1, width).cumsum(1) for w in (g, h)]
                left_g, left_h = sums[0], sums[1]
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_h < 0.5) | (all_h - left_h < 0.5)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(len(top)), top] > best
                column[better], edge[better] = j, top[better]
                best[better] = gain[np.arange(len(top)), top][better]
            splits.append((column, edge))
            node = node * 2 + (binned[np.arange(len(g)), column[node]] > edge[node])
        leaf = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
        return splits, leaf

    def _apply(self, tree, binned):
        node = np.zeros(len(binned), int)
        for column, edge in tree[0]:
            node = node * 2 + (binned[np.arange(len(binned)), column[node]] > edge[node])
        return tree[1][node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        return self.start + sum(self._apply(t, binned) for t in self.trees)


class Model:
    """Trees, a logistic calibration of their margin, and a threshold for each kind."""

    def __init__(self, rows: np.ndarray):
        held = np.arange(len(rows)) % 10 >= 7
        x, y = rows[:, 1:], rows[:, 0]
        self.trees = Trees(x[~held], y[~held])
        margin, label = self.trees.margin(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(100):  # Platt scaling by gradient steps on two numbers
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            a -= 0.05 * float(((p - label) * margin).mean())
            b -= 0.05 * float((p - label).mean())
        self.scale, self.threshold = (a, b), {}
        p = self.calibrated(margin)
        for i, kind in enumerate(KINDS):
            own = x[held][:, 0] == i
            ranked = np.argsort(-p[own], kind="stable")
            hits = np.cumsum(label[own][ranked]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero((hits >= PRECISION) & (np.cumsum(label[own][ranked]) >= 10))
            self.threshold[kind] = max(0.5, float(p[own][ranked][good[-1]])) if len(good) else 2.0

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -30, 30)))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | None:
    """Learn from about `sample` documents, chosen by a hash of the text's row; at most ROWS candidates of
    them, in hash order, reach the driver. None if they hold fewer than 20 of either label."""
    from pyspark.sql import functions as F

    some = sampled(docs.select(F.col(text).alias("text")), ["text"], sample)
    rows = annotate(some, "text", "rows", T.ArrayType(T.ArrayType(T.DoubleType())), lambda texts: [labelled(t) for t in texts]) \
        .select(F.explode("rows").alias("row")).orderBy(F.xxhash64("row"), "row").limit(ROWS).collect()
    table = np.array([r["row"] for r in rows])
    if not len(table) or min(table[:, 0].sum(), (1 - table[:, 0]).sum()) < 20:
        return None
    return Model(table)


def spans(texts: list, model: Model | None) -> list[list[dict]]:
    """All spans of each text, by kind as listed and then by start. The strict ones stay. Of the other
    candidates those reach their kind's threshold that overlap none chosen before: by score, then the
    earlier and the longer. The candidates of all texts are scored together."""
    strong = [[(k, s, e) for k, s, e, ok in strict(t) if ok] if t else [] for t in texts]
    weak = [sorted(set(loose(t)) - set(strong[i])) if t and model else [] for i, t in enumerate(texts)]
    rows = [features(k, texts[i][s:e], *context(texts[i], s, e)) for i, own in enumerate(weak) for k, s, e in own]
    scores = iter(model.calibrated(model.trees.margin(np.array(rows, float))) if rows else ())
    out = []
    for found, proposed in zip(strong, weak):
        keep = [{"kind": k, "start": s, "end": e, "base": True, "score": 1.0} for k, s, e in found]
        taken = sorted((s, e) for _, s, e in found)  # strict spans of other kinds block as well
        for score, (k, s, e) in sorted(((next(scores), c) for c in proposed), key=lambda c: (-c[0], c[1][1], -c[1][2])):
            at = bisect_right(taken, (s, 1 << 62))
            clash = any(a < e and s < b for a, b in taken[max(0, at - 4):at + 1])
            if score >= model.threshold[k] and not clash:
                taken.insert(at, (s, e))
                keep.append({"kind": k, "start": s, "end": e, "base": False, "score": float(score)})
        out.append(sorted(keep, key=lambda x: (KINDS.index(x["kind"]), x["start"], x["end"])))
    return out


def find(docs: DataFrame, model: Model | None, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column `out` of spans (kind, start, end in code points, base, score). Null and empty
    texts have none, very long texts are read whole in linear time, repeated rows repeat, an empty table
    stays empty, other columns stay. Without a model only the strict patterns answer."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few tens of KB at any size
    return annotate(docs, text, out, T.ArrayType(SPAN), lambda texts: spans(texts, held.value))
