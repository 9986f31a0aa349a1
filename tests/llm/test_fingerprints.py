import hashlib
import random

import numpy as np
import pytest
from helpers import EDGE_TEXTS, SF, doc, save

from pixelsieve.llm import fingerprints as X


def kmers(text):
    return [text[i : i + X.K] for i in range(max(1, len(text) - X.K + 1))] if text else []


def brute(text):
    """Selection by plain loops over numbered k-mers, with the module's hash of each."""
    hashes, numbered = X.numbered_kmers(text)
    assert len(hashes) == len(kmers(text))
    out = []
    for f in range(X.SKETCHES):
        values = X._values(numbered)[f].tolist() if len(numbered) else []
        out.append(tuple(sorted(sorted(range(len(values)), key=lambda i: (values[i], i))[: X.TUPLE])))
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaa", "the cat sat on the mat and the cat sat again", "é日\U0001f600" * 9])
def test_selection(text):
    numbered = X.numbered_kmers(text)[1]
    if len(numbered):
        assert [tuple(r) for r in X._smallest(numbered).tolist()] == brute(text)
    words = kmers(text)
    hashes = X.numbered_kmers(text)[0].tolist()
    assert len({*zip(words, hashes)}) == len(set(words))
    seen = {}
    for w, n in zip(words, X.numbered_kmers(text)[1].tolist()):
        seen.setdefault(w, []).append(n)
    assert all(len(set(v)) == len(v) for v in seen.values())


def test_blocks(monkeypatch):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(5000))
    whole = X.sketch(text)
    monkeypatch.setattr(X, "_BLOCK", 64 * 100)
    assert np.array_equal(X.sketch(text), whole)


def test_follows_edits():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    half = len(text) // 2
    near = X.likeness(X.sketch(text), X.sketch(text[:1000] + "inserted words" + text[1000:]))
    moved = X.likeness(X.sketch(text), X.sketch(text[half:] + text[:half]))
    other = X.likeness(X.sketch(text), X.sketch("".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))))
    assert near > 0.85 and 0.2 < moved < 0.75 and other < 0.05


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        a, b, c = X.sketch(t), X.sketch(edited), X.sketch(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), X.to_string(a), X.to_string(b), X.likeness(a, b), X.likeness(a, c)))
    return sorted(out, key=str)


def run(spark, path):
    return sorted((tuple(r) for r in X.op7_fingerprints(spark, path).collect()), key=str)


def test_query(spark, tmp_path):
    rows = [doc(i * 3 - 9, t) for i, t in enumerate(EDGE_TEXTS)] + [doc(None, "no id at all"), doc(9000, "tail"), doc(9000, "tail")]
    assert run(spark, save(spark, tmp_path, rows)) == want([(r[0], r[1]) for r in rows])
    assert run(spark, save(spark, tmp_path, [])) == []
    one = [doc(1, "only one document here")]
    assert run(spark, save(spark, tmp_path, one)) == want([(1, one[0][1])])


def test_sample(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = run(spark, SF)
    assert got == want(rows)
    assert len({g[3] for g in got}) <= len({t for _, t in rows})
    assert sorted(r["fingerprint"] for r in X.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()) == sorted(g[3] for g in got)


def test_number_below(spark):
    rng = random.Random(6)
    for n in (1, 2, 3, 7, 8, 100, 1000):
        points = sorted(rng.sample(range(-5000, 5000), n))
        ids = [rng.randrange(-6000, 6000) for _ in range(200)] + points
        got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", X._number_below(points, "id").alias("n")).collect()
        assert all(r["n"] == sum(p < r["id"] for p in points) for r in got)


def test_many_ranges(spark):
    rows = [(i * 7 % 1009, f"text number {i} " * 3) for i in range(1009)]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = X.in_order_with_next(df, X._pairs, schema, ranges=300).collect()
    assert sorted(tuple(r) for r in out) == sorted(want(rows), key=lambda r: r[0])
