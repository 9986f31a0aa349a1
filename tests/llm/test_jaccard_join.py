import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import EDGE_TEXTS, SF, doc, save

from pixelsieve.llm import jaccard_join as X
from pixelsieve.llm.components import connected_components


def plain_set(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    """(id, set size, component, number of links) by comparing all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in by[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(sets[i]), least[find(i)], n[i]) for i, (key, _) in enumerate(rows))


def run(df, **kw):
    return sorted(tuple(r) for r in X.jaccard_components(df, **kw).select("id", "n_shingles", "component_id", "n_links").collect())


def near_copies(seed, groups=25, hot=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 5, 9, 14, 25, 60, 200, 700]))]
        if g % 3 == 0:
            base += passage
        for _ in range(hot if g == 1 else rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, len(words) // 30])):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                words[at : at + (kind != 0)] = [rng.choice(vocab)] if kind < 2 else []
                words = words or ["x"]
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,k,percent,block", [(1, 3, 90, 1000), (2, 5, 80, 1000), (3, 3, 90, 7), (4, 2, 60, 5), (5, 5, 80, 3)])
def test_brute_force(spark, seed, k, percent, block):
    rows = near_copies(seed)
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, block=block)
    want = brute(rows, k, percent)
    assert got == want
    assert len({w[2] for w in want}) < len(rows)


@pytest.mark.parametrize("short", [2, 3])
def test_long_lists(spark, monkeypatch, short):
    """With nearly all names on long lists. Workers of tests run in processes of their own, so that the bound is
    set where they read it."""
    spark_short = X._shared

    def run_short(batches):
        X.SHORT = short
        return spark_short(batches)

    monkeypatch.setattr(X, "_shared", run_short)
    for k, percent in ((3, 90), (5, 80)):
        rows = near_copies(10 + short)
        assert run(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent) == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_light_classes(spark, monkeypatch, k, percent):
    """With small sets by subsets of parts; a group of sets on both sides of the boundary."""
    monkeypatch.setattr(X, "boundary", lambda sizes, percent: 7)
    rows = near_copies(8)
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent) == brute(rows, k, percent)


def test_ball(spark):
    """A large group of near copies, some of which are far from the text that they come from, and copies of copies."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 5, 6, 7])):
            words[rng.randrange(300)] = f"x{i}"
        rows.append((i + 10, " ".join(words)))
    rows += [(1000 + i, rows[rng.randrange(260)][1].upper()) for i in range(40)]
    for block in (20, 1000):
        assert run(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90, block=block) == brute(rows, 3, 90)


def test_ids_of_two_texts(spark):
    """Two texts of one id, both in one group of near copies: the links of both count."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (10, 50, 90)] + [" ".join(base)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[3]), (0, texts[3])]
    for block in (1, 2, 500):
        assert run(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=80, block=block) == brute(rows, 3, 80)


def test_packed():
    """Names on more nodes than SHORT are passed on as they are, with a mark for their bucket."""
    a = np.zeros(2 * X.SHORT + 3, X._RECORD)
    a["name"] = [7] * (X.SHORT + 1) + [8] * X.SHORT + [9, 9]
    a["node"] = np.arange(len(a)) * 2
    rows = X._packed(a, 4).to_pylist()
    known = [r for x in rows if x["long"] for r in np.frombuffer(x["data"], X._RECORD).tolist()]
    asked = [r for x in rows if not x["long"] for r in np.frombuffer(x["data"], X._RECORD).tolist()]
    assert known == [(7, 2 * i) for i in range(X.SHORT + 1)] and (7, X.MARK) in asked and len(asked) == X.SHORT + 3


def test_edges(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(40, "HELLO,\x0bworld!"), (41, "one two"), (42, "ONE\ttwo"), (43, "one two three"), (6, "same text here")]
    path = save(spark, tmp_path, [doc(i, t) for i, t in rows])
    got = sorted(tuple(r) for r in X.op5_jaccard_join(spark, path).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute(rows, 3, 90)
    assert X.op5_jaccard_join(spark, save(spark, tmp_path, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 1), (1, "a b c", 2), (2, "a b c", 3), (2, "x y z", 4)], "doc_id long, text string, component_id int")
    out = sorted(map(tuple, X.jaccard_components(odd, k=3, percent=90).collect()), key=str)
    assert out == sorted([(None, 1, None, 0), (1, 1, 1, 1), (2, 1, 1, 1), (2, 1, 2, 0)], key=str)


def test_sample(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in X.op5_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == brute(rows, 3, 90)


def test_names_meet():
    """Linked sets share as many names as they need, in a class in which both have names."""
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90):
        for below in (0, 6):
            classes = X.Classes(percent, below)
            for _ in range(150):
                n = int(rng.integers(1, 160))
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                drop, add = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                    continue
                common = set(classes.meets_in(len(a))) & set(classes.meets_in(len(b)))
                assert common
                c = min(common)
                (x, need_x), (y, need_y) = X.names(a, c, classes), X.names(b, c, classes)
                shared = len(np.intersect1d(x, y))
                assert shared >= max(need_x, need_y)


def test_linked_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(48, 60)], rng.integers(0, 2**63, 2, dtype=np.uint64)))) for _ in range(30)]
    whole = X.linked(sets, 70)
    assert whole.any() and (whole == whole.T).all()
    part = X.linked(sets, 70, split=11)
    assert (part[:11, 11:] == whole[:11, 11:]).all() and not part[:11, :11].any() and not part[11:, 11:].any()


def test_boundary():
    assert X.boundary({}, 90) == 0 and X.boundary({3: 5}, 90) >= 0
    assert X.boundary({c: 10**4 for c in range(25)}, 80) > X.boundary({c: 10 for c in range(25)}, 80)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_forget_sizes(spark):
    """Estimated sizes are not multiplied from round to round, whatever the number of rounds."""
    out = connected_components(spark.range(300).selectExpr("id a", "id + 1 b"))
    assert out._jdf.queryExecution().optimizedPlan().stats().simpleString().endswith("EiB")
    assert {tuple(r) for r in out.collect()} == {(x, 0) for x in range(301)}


def test_drop(spark):
    rows = near_copies(6)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    kept = X.drop_near_duplicates(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows, 5, 80) if r[0] == r[2])
