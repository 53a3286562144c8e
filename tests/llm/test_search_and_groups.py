"""Prefix trie, spelling variants and nearest neighbours against plain versions, and their odd inputs."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import ann, prefix_trie, variants
from tidegauge.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


# ---- prefix trie ---------------------------------------------------------------------------------------------

def plain_trie(rows):
    """(conv_id, turn, role, text) rows to the result rows, by walking a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children[p]]
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    out = set()
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(whole[c]) == len(p))))
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), *sums[p],
                 hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


CONVERSATIONS = "turn bigint, conv_id bigint, text string, role string, name string, depth string, low int, up string"


def conversations(spark, rows):
    return spark.createDataFrame([(t, c, x, r, "x", "x", 1, "x") for c, t, r, x in rows], CONVERSATIONS)


def trie_rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_the_plain_one(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(60):
        at = list(range(rnd.choice([0, 1, 2, 9, 12, 30])))
        rows += [(c, t if t else None, rnd.choice(["user", "bot", None]), rnd.choice(["a", "", None, "héé", "long " * 50])) for t in at]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (None, 1, "user", "lost"), (10**12 + 3, 10**9, "u", "t")]
    got = trie_rows(prefix_trie.trie(conversations(spark, rows), segment=4, at_once=7, turns_at_once=20))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_copies_and_long_conversations(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(3)]
    long_ = [(1003, t, "user", str(t % 3)) for t in range(3000)] + [(1004, t, "user", str(t % 3)) for t in range(2990)]
    rows = same + long_
    got = trie_rows(prefix_trie.trie(conversations(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(prefix_trie.trie(conversations(spark, []))) == []
    assert trie_rows(prefix_trie.trie(conversations(spark, [(None, 1, "user", "x")]))) == []


# ---- spelling variants -----------------------------------------------------------------------------------------

def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_variants(rows):
    import re

    counts = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


DOCUMENTS = "text string, doc_id bigint, word string, n string, state string, near int"


def documents(spark, rows):
    return spark.createDataFrame([(t, d, "x", "x", "x", 1) for d, t in rows], DOCUMENTS)


@pytest.mark.parametrize("seed,most", [(1, 2048), (2, 6), (3, 2)])
def test_variants_are_the_plain_ones(spark, seed, most):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 10))) for _ in range(120)] + ["Staircase", "x" * 70, "x" * 71]
    rows = [(i, rnd.choice([" ", "-", "€"]).join(rnd.choices(words, [1 / (j + 1) ** 1.3 for j in range(len(words))], k=rnd.randint(0, 120)))) for i in range(60)]
    rows += [(None, "nullnull nullnull"), (None, None), (4, ""), (4, "WÖRTER WÖRTER Wörter WORDWORD wordword"), (4, "WÖRTER WÖRTER Wörter WORDWORD wordword")]
    rows += [(100 + i, "commonword " * 12) for i in range(90)] + [(300 + i, "commonwerd " * 6) for i in range(9)] + [(320 + i, "commonwed") for i in range(3)]
    got = [tuple(r) for r in variants.groups(documents(spark, rows), most=most).collect()]
    want = plain_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)  # forms, and chains of them


def test_partition_is_composed_like_the_definition():
    rnd = random.Random(5)
    for t in range(400):
        letters = "ab" if t % 2 else "abcé"
        size = rnd.randint(1, 9)
        a = rnd.randint(0, size - 1)
        b = rnd.randint(a + 1, size)
        head, tail = ("".join(rnd.choice(letters) for _ in range(k)) for k in (a, size - b))
        words = {head + "".join(rnd.choice(letters) for _ in range(b - a - rnd.randint(0, 1))) + tail: rnd.randint(1, 5) for _ in range(25)}
        want = {}
        for u, v in itertools.combinations(sorted(words), 2):
            place = next((i for i, (x, y) in enumerate(zip(u, v)) if x != y), min(len(u), len(v)))
            if one_edit(u, v) and max(len(u), len(v)) == size and a <= place < b:
                for x, y in ((u, v), (v, u)):
                    n, best = want.get(x, (0, (1, "")))
                    want[x] = (n + 1, min(best, (-words[y], y)))
        assert {w: (n, (-m, o)) for w, n, m, o in variants.composed(words, size, a, b)} == want


def test_acceptor_is_minimal():
    register = {}
    start = variants.Acceptor(register, [x + y for x in ("ab", "cd", "ef") for y in ("ing", "ess")]).start
    assert sorted(variants.language(start)) == sorted(x + y for x in ("ab", "cd", "ef") for y in ("ing", "ess"))
    assert len({id(to) for _, to in start}) == 1 and len(register) == 2


def test_variants_of_long_texts_and_nothing(spark):
    long_ = "wordword " * 40_000 + "y" * 50_000 + " " + "y" * 50_000 + " " + "y" * 50_001 + " " + "y" * 50_001
    rows = [(1, long_), (2, long_)]
    assert {tuple(r) for r in variants.groups(documents(spark, rows)).collect()} == plain_variants(rows)
    assert variants.groups(documents(spark, [])).collect() == []
    assert variants.groups(documents(spark, [(1, None), (2, "short")])).collect() == []


# ---- nearest neighbours ----------------------------------------------------------------------------------------

def exact(vectors, queries, k):
    """{query: [(id, score)]} for {id: vector}."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for q in queries:
        s = (x * vectors[q]).sum(1)
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))
        out[q] = [(int(ids[i]), s[i]) for i in order if ids[i] != q][:k]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


VECTORS = "embedding array<float>, vec_id bigint, vec string, cell int, q int, asked boolean"


def vectors_of(spark, rows):
    return spark.createDataFrame([(None if v is None else [None if x is None else float(x) for x in v], i, "x", 1, 1, True) for i, v in rows], VECTORS)


@pytest.mark.parametrize("kind", ["random", "clustered", "norms"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    if kind == "clustered":
        x = (rng.standard_normal((60, 32)).repeat(50, 0) + 0.3 * x).astype(np.float32)
    if kind == "norms":
        x = x * rng.lognormal(0, 1, (3000, 1)).astype(np.float32)
    vectors = {i: v.astype(float) for i, v in enumerate(x)}
    df = vectors_of(spark, list(enumerate(x)))
    got = answers(ann.search(df, F.col("vec_id") % 20 == 0, cell=200))
    want = exact(vectors, range(0, 3000, 20), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - (vectors[q] * vectors[i]).sum()) < 1e-9 for i, s in found)


def test_nearest_on_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r[0]: np.array(r[1], float) for r in rows}
    got = answers(QUERIES["op13_nearest"](spark, SF))
    assert recall(got, exact(vectors, [i for i in vectors if i % 20 == 0], 20)) >= 0.9


def test_nearest_odd_rows(spark):
    """Copies beyond the result's size, repeated rows, unusable vectors, short vectors, few candidates."""
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(0, 100)] + [(20, one)] * 50
    rows += [(200, None), (201, [0.0] * 3), (202, [1.0, None, 0.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 0.0, 0.0]), (None, one), (205, [])]
    rows += [(300, [0.5]), (301, [-1.0, 0.0, 0.0]), (302, [0.0, 1.0, 0.0])]
    got = answers(ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0))
    assert set(got) == {0, 20, 40, 60, 80, 300}
    assert [i for i, _ in got[20]] == [i for i in range(21) if i != 20]
    assert got[0] == [(i, 1.0) for i in range(1, 21)] and got[300] == [(i, 0.5) for i in range(20)]
    few = answers(ann.search(vectors_of(spark, rows[-3:] + [(320, one)]), F.col("vec_id") % 20 == 0))
    assert few == {300: [(320, 0.5), (302, 0.0), (301, -0.5)], 320: [(300, 0.5), (302, 0.0), (301, -1.0)]}
    assert ann.search(vectors_of(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(vectors_of(spark, [(20, one)]), F.col("vec_id") % 20 == 0).collect() == []


# ---- the queries -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    from check_queries import connect, key

    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(SQL[name])
    assert key([tuple(r) for r in df.collect()], df.columns) == key(cur.fetchall(), [c[0] for c in cur.description])
