"""The prefix trie, the n-gram join and the whitening against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigframe.llm import conversation_trie, ngram_join, spectrum_whitening
from sigframe.llm.common import spread_join


# ---- trie --------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, p string, depth int, key string"


def brute_trie(rows):
    def tok(r, x):
        return hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()

    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, tok(r or "", x or ""), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    members, ends, kids, up, text, depth, name = defaultdict(list), defaultdict(list), defaultdict(set), {}, {}, {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        at = 0
        for node in [None, *own.get(c - int(math.fmod(c, 100)), [])[:h], *own[c][h:]]:
            if node is not None:
                below = name.setdefault((at, node), len(name) + 1)
                kids[at].add(below)
                up[below], text[below] = at, node[1]
                at = below
            depth[at] = depth[up[at]] + 1 if at else 0
            members[at].append(c)
        ends[at].append(c)
    leaves, saved = {}, {}
    for v in sorted(depth, key=lambda v: -depth[v]):
        leaves[v] = sum(leaves[k] for k in kids[v]) or 1
        saved[v] = ((len(members[v]) - 1) * len(text[v]) if v else 0) + sum(saved[k] for k in kids[v])
    return [(min(members[v]), depth[v], min(members[up[v]]) if v else None, len(members[v]), len(kids[v]), leaves[v], saved[v],
             hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()) for v in depth]


def conversations():
    """Short ones, copies, long ones that share long beginnings, ties, nulls, one turnless after rebuilding."""
    rnd = random.Random(3)
    rows = []
    long = [("user" if i % 2 else "bot", f"turn {rnd.random()}é😀") for i in range(60)]
    for c in [*range(-3, 40), 100, 101, 102, 199, 300, 350, 777]:
        kind = c % 5
        if kind == 0:
            turns = long[:rnd.choice([3, 15, 16, 17, 40])] + [("user", f"end {rnd.randrange(3)}")] * rnd.randrange(3)
        elif kind == 1:
            turns = long[:7] + [("user", f"own {c} {i}") for i in range(rnd.randrange(30))]
        elif kind == 2:
            turns = [("user", "hello"), ("bot", "")]
        elif kind == 3:
            turns = [(None, None)]
        else:
            turns = [("user", "hello")] * 9
        rows += [(c, i if i % 7 or kind == 2 else None if i == 0 else i, r, x) for i, (r, x) in enumerate(turns)]
    rows += [(500 + i, t, r, x) for i in range(100) for t, (r, x) in enumerate(long[:20])]  # copies
    rows += [(None, 1, "user", "nobody"), (5, 2, "bot", "tie"), (5, 2, "user", "tie"), (5, 2, "user", "tie")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,shard", [(512, 400_000), (8, 25), (6, 6), (16, 1)])
def test_trie_equals_brute_force(spark, segment, shard):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], TURNS).repartition(5)
    got = [tuple(r) for r in conversation_trie.trie(df, segment, shard).collect()]
    assert Counter(got) == Counter(brute_trie(rows))


def test_trie_of_an_empty_table(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b", "", 1, "")], TURNS)).collect() == []


def test_ternary_tree_is_balanced_and_whole():
    seqs = sorted({tuple([0] + [random.Random(i * 31 + j).randrange(4) for j in range(i % 7)]) for i in range(400)} | {(0, i) for i in range(4, 1000)})
    tree = conversation_trie.Tree()
    tree.fill([list(s) for s in seqs])
    path, seen, steps = {}, set(), 0
    for n, (node, parent, depth) in enumerate(tree.walk()):
        path[n] = (path[parent] if parent >= 0 else ()) + (tree.char[node],)
        assert len(path[n]) == depth + 1
        if tree.row[node] >= 0:
            assert seqs[tree.row[node]] == path[n]
            seen.add(path[n])
    assert seen == set(seqs)
    assert len(path) == len({s[:i] for s in seqs for i in range(1, len(s) + 1)})
    node = tree.equal[0]
    while tree.char[node] != 999:  # a thousand children, met after few comparisons
        node, steps = tree.high[node] if tree.char[node] < 999 else tree.low[node], steps + 1
    assert steps <= 12


# ---- join --------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, n int, cls string, th int, token string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 4 else [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)])


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def texts():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):  # near copies at all distances, chains included
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    for i in range(40):  # a common line with a little of their own
        rows.append((2000 + i, " ".join(base[:30] + [word() for _ in range(rnd.randrange(1, 9))])))
    for i in range(40):
        rows.append((3000 + i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 5, 30])))))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one two"), (5, "ONE TWO"), (6, "one  two"), (None, "one two"),
             (None, "of none"), (None, None), (7, "a b c d"), (7, "a b c d"), (8, "a b c"), (9, "x " * 40000 + "é"), (10, "X " * 40000 + "é"),
             (11, "ÀB c d e"), (12, "àb c d e")]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = texts()
    df = spark.createDataFrame([(d, t, "en", 1, "c", 2, "t") for d, t in rows], DOCS).repartition(4)
    got = ngram_join.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == brute_join(rows)


def test_join_needs_no_true_frequencies(spark, monkeypatch):
    """The rarest-first order decides speed only: any order gives the same components."""
    monkeypatch.setattr(ngram_join, "rarity", lambda known: np.zeros(ngram_join.BUCKETS, np.uint8))
    rows = texts()
    df = spark.createDataFrame([(d, t, "en", 1, "c", 2, "t") for d, t in rows], DOCS)
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute_join(rows)


def test_join_of_an_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_least_overlap_is_the_bound():
    for a in range(1, 60):
        for b in range(a, 60):
            linked = [o for o in range(a + 1) if 100 * o >= 85 * (a + b - o)]
            assert ngram_join.least_overlap(a + b) == min(linked, default=ngram_join.least_overlap(a + b))


def test_texts_are_hashed_alike_in_blocks(monkeypatch):
    text = " ".join(f"Word{i}\té　x" for i in range(3000))
    whole = ngram_join._words(text)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 17)
    assert (ngram_join._words(text) == whole).all() and len(whole) == len(text.encode().split())


def test_spread_join_keeps_every_row(spark):
    big = spark.createDataFrame([(1, i) for i in range(900)] + [(i, i) for i in range(2, 1500)], "k long, v long")
    small = big.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as w")
    got = spread_join(big, small, "k", "n")
    assert got.columns == ["k", "v", "w"] and got.filter("w = 2 * k").count() == big.count() == got.count()


# ---- whitening ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, component int, x string, n long"


def reference(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return x, n, s, v, e, q


def test_whitening_equals_a_dense_solver(spark):
    rnd = np.random.default_rng(2)
    vectors = (rnd.normal(size=(300, 20)) * np.linspace(3, 1, 20) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(7, vectors[7].tolist()), (None, vectors[9].tolist())] * 3  # repeated rows and null ids
    bad = [(1, None), (2, []), (3, [None] * 20), (4, [float("nan")] * 20), (5, [float("inf")] * 20), (6, [1e30] * 20)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows + bad], VECTORS).repartition(4)
    got = spectrum_whitening.whiten(df).collect()
    x, n, s, v, e, q = reference(vectors)
    assert len(got) == len(rows) * 16 and {r["n"] for r in got} == {n}
    white = (x - s / n) @ q[:, :16] / np.sqrt(e[:16])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    signs = {r["component"]: np.sign(r["whitened"] * white[0, r["component"] - 1]) for r in got if r["vec_id"] == 0}
    for r in got:
        i, c = 9 if r["vec_id"] is None else r["vec_id"], r["component"]
        assert abs(r["whitened"] * signs[c] - white[i, c - 1]) < 1e-9
        assert r["deviation"] == deviation[i]
        assert abs(r["explained"] - e[c - 1] / np.trace(v)) < 1e-12
        assert r["identity_error"] < 1e-10


def test_whitening_of_small_and_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    assert spectrum_whitening.whiten(frame([])).collect() == []
    assert spectrum_whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    two = spectrum_whitening.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9)), r["n"], r["deviation"]) for r in two) == [
        (1, 1, 1.0, 2, 4096), (2, 1, 1.0, 2, 4096), (3, 1, 1.0, 2, 4096), (4, 1, 1.0, 2, 4096)]
    far = spectrum_whitening.whiten(frame([(1, [2.0 ** 45]), (2, [0.0])])).collect()
    assert {r["deviation"] for r in far} == {None} and all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in far)


def test_inertia_and_leading_pairs():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 40):
        a = rnd.normal(size=(n, n))
        a = a + a.T
        for shift in (0.0, 1.0, -2.5, float(a[0, 0])):
            assert spectrum_whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()
        p = a @ a
        e, q = spectrum_whitening.leading(p, 5)
        assert np.allclose(e, np.linalg.eigvalsh(p)[::-1][:len(e)], rtol=0, atol=1e-10 * e[0])
        assert np.abs(p @ q - q * e).max() < 1e-10 * e[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-12
    for a, want in ((np.eye(9), 9), (np.diag([3.0, 3, 3, 2, 2, 0]), 5), (np.zeros((3, 3)), 0), (np.diag([1, 1 + 1e-12, 0.5]), 3)):
        e, q = spectrum_whitening.leading(a, 16)
        assert len(e) == want and np.abs(a @ q - q * e).max(initial=0) < 1e-10 and (np.diff(e) <= 0).all()
