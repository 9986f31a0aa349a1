import hashlib
import random
from collections import defaultdict

from helpers import DOCS, EDGE_TEXTS, SF, doc, save

from pixelsieve.llm import exact_dedup as X


def brute(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g)
        out.append((i, best[1], len(g), (-len(t or ""), i) == best, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def run(spark, path):
    return sorted(tuple(r) for r in X.op9_exact_dedup(spark, path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_edges(spark, tmp_path):
    rows = [doc(i, t) for i, t in enumerate(EDGE_TEXTS)]
    rows += [doc(100, "same  text\nhere"), doc(101, "sametexthere"), doc(102, "long " * 40000), doc(103, "long" * 40000), doc(104, "a"), doc(104, "a")]
    assert run(spark, save(spark, tmp_path, rows)) == brute([(r[0], r[1]) for r in rows])


def test_empty_table(spark, tmp_path):
    assert run(spark, save(spark, tmp_path, [])) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "q"), (2, "ab", 6, "q")], "doc_id long, text string, keep_id long, recipe string")
    assert {(r["id"], r["keep_id"]) for r in X.exact_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_drop(spark):
    rows = [doc(i, t) for i, t in enumerate(EDGE_TEXTS)] + [doc(90, "b c d"), doc(90, "b c d"), doc(91, "bcd"), doc(None, "lone"), doc(None, "lone")]
    kept = sorted((tuple(r) for r in X.drop_exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert kept == sorted({r for r, b in zip(sorted(rows, key=str), sorted(brute_keys(rows), key=str)) if b[1]}, key=str)


def brute_keys(rows):
    """Each row, and whether it is the one of its group that stays."""
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    best = {}
    for r in rows:
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[norm(r[1])] = min(best.get(norm(r[1]), key), key)
    return [(r, (-len(r[1] or ""), r[0] is None, r[0] or 0) == best[norm(r[1])]) for r in rows]


def test_sample(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, SF) == brute(rows)


def test_chunks_follow_content():
    rng = random.Random(1)
    a = bytes(rng.randrange(97, 123) for _ in range(200_000))
    b = b"prefix" + a
    ca, cb = {c[1] for c in X.chunks_of(a)}, {c[1] for c in X.chunks_of(b)}
    assert len(ca & cb) >= 0.9 * len(ca) and len(ca) > 20
    assert X.boundaries(b"") == [] and X.boundaries(b"abc") == [3]
    assert max(y - x for x, y in zip([0, *X.boundaries(b"z" * 300000)], X.boundaries(b"z" * 300000))) <= X.MAX_CHUNK


def test_one_fingerprint_two_contents(spark):
    """Chunks whose short fingerprints collide get two identifiers."""
    parts = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 1, 1), (8, 5, 5)], "h long, d1 long, d2 long")
    known = parts.distinct().selectExpr("h", "d1", "row_number() over (partition by h order by d1, d2) as v")
    assert sorted(map(tuple, known.collect())) == [(7, 1, 1), (7, 2, 2), (8, 5, 1)]
    assert DOCS
