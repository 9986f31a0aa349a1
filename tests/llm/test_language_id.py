import zlib

import numpy as np
from helpers import EDGE_TEXTS, SF, doc, save

from pixelsieve.llm import language_id as X


def direct(text):
    """A document's vector, place by place."""
    s = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or s[-1]:
            s.append(code)
    if s[-1]:
        s.append(0)
    out = np.zeros(X.DIMENSIONS)
    for a, b, c in zip(s, s[1:], s[2:]):
        out += np.roll(X.letter_vector(a), 2) * np.roll(X.letter_vector(b), 1) * X.letter_vector(c)
    return out


def test_bundles():
    for text in ["a", "Hello, hello  World", "été\U0001f600日本", "x" * 9000, "a b c d e f g" * 50]:
        assert np.array_equal(X.Profiles().bundle(*X.trigrams(text)), direct(text))
    assert not len(X.trigrams("123 !?")[0])


def test_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(X, "REMEMBERED", 40)
    p = X.Profiles()
    for text in ["the quick brown fox jumps", "over the lazy dog again", "pack my box with five dozen"]:
        assert np.array_equal(p.bundle(*X.trigrams(text)), direct(text))
        assert len(p.rows) <= 40


def test_brute_force_and_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    sums = {}
    for r in docs:
        if not held(r) and r["lang"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + direct(r["text"])
    langs = sorted(sums)
    matrix = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    got = {r["doc_id"]: r for r in X.op6_language_id(spark, SF).collect()}
    right = 0
    for r in docs:
        v = direct(r["text"])
        cosines = matrix @ v / np.linalg.norm(v)
        assert got[r["doc_id"]]["held_out"] == held(r)
        assert got[r["doc_id"]]["lang_pred"] == langs[int(np.argmax(cosines))]
        assert abs(got[r["doc_id"]]["score"] - max(0, cosines.max())) < 1e-9
        right += got[r["doc_id"]]["lang_pred"] == r["lang"]
    assert right >= 0.98 * len(docs) and len(got) == len(docs)


def test_edges(spark, tmp_path):
    rows = [doc(i, t, lang=[None, "en", "de"][i % 3]) for i, t in enumerate(EDGE_TEXTS)] + [doc(7, "again"), doc(7, "again")]
    out = X.op6_language_id(spark, save(spark, tmp_path, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and 0 <= r["score"] <= 1
    assert X.op6_language_id(spark, save(spark, tmp_path, [])).count() == 0
    unlabelled = save(spark, tmp_path, [doc(1, "some text", lang=None)])
    assert [r["lang_pred"] for r in X.op6_language_id(spark, unlabelled).collect()] == ["und"]


def test_keep_known(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = X.train(docs)
    bad = spark.createDataFrame([doc(-1, "12345 !!"), doc(-2, None), doc(-3, "привет мир " * 60), doc(-4, "ok")], docs.schema)
    kept = X.keep_known(docs.unionByName(bad), known)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} | {-4}


RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства"
FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
ITALIAN = "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza."


def test_bounds_by_length(spark):
    """Texts too short for the fixed bound, and unlearned languages above it, go; all labelled rows stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.collect() if len(r["text"]) > 400 and len(set(r["text"][:160].split())) > 15]  # one word over and over is noise
    short = [doc(10_000 + i, r["text"][:160], lang=r["lang"]) for i, r in enumerate(rows)]
    labelled = docs.unionByName(spark.createDataFrame(short, docs.schema))
    known, bounds = X.learn(labelled)
    assert all(np.array_equal(v, known[k]) for k, v in X.train(labelled).items()) and min(bounds.values()) > X.NOISE
    strange = [doc(-1 - i, t, lang=None) for i, t in enumerate([RUSSIAN, FINNISH, ITALIAN, FINNISH * 2, ITALIAN * 2])]
    table = labelled.unionByName(spark.createDataFrame([*strange, doc(-9, "ok", lang=None)], docs.schema))
    kept = {r["doc_id"] for r in X.keep_known(table, known, bounds=bounds).collect()}
    assert kept == {r["doc_id"] for r in labelled.collect()} | {-9}


def test_no_bounds_without_labels(spark):
    docs = spark.createDataFrame([doc(1, "some text", lang=None)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert X.learn(docs) == ({}, {})
