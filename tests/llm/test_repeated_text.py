import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE_TEXTS, SF, doc, save

from pixelsieve.llm import repeated_text as X


def brute(texts, length):
    """For each text (bytes), the removed runs."""
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        runs, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(t) if end < 0 else end
            runs.append((at, end))
            at = end
        out.append(runs)
    return out


def run(spark, texts, length):
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["id"]: (r["kept"], [(s["start"], s["end"]) for s in r["spans"]]) for r in X.remove_repeats(df, length).collect()}
    return [got[i] for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    passage, line = text(130), text(61)
    out = [text(rng.randrange(0, 400)) for _ in range(20)]
    for _ in range(25):
        parts = [text(rng.randrange(0, 90)), rng.choice([passage, passage[rng.randrange(60) :], passage[: rng.randrange(40, 130)], line]), text(rng.randrange(0, 90))]
        if rng.random() < 0.4:
            t = bytearray(rng.choice(out))
            if t:
                t[rng.randrange(len(t))] = 120
            parts.append(bytes(t))
        out.append(b"".join(parts))
    out += [b"z" * 150, b"z" * 39, b"ab" * 80, line * 5, out[0], out[0] + b"!", b"", b"q" * 40, passage]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,length", [(1, 40), (2, 32), (3, 64), (4, 100)])
def test_brute_force(spark, seed, length):
    texts = corpus(seed)
    want = brute(texts, length)
    got = run(spark, texts, length)
    assert [g[1] for g in got] == want
    for t, (kept, runs) in zip(texts, got):
        assert kept == bytes(c for k, c in enumerate(t) if not any(s <= k < e for s, e in runs))
    assert any(want)


def test_often(spark, monkeypatch):
    """Tasks that answer for themselves what they have often."""
    texts = [b"%08d" % (i * 7919) + b"the passage that very many documents share, without change" + b"%08d" % (i * 104729) for i in range(200)]
    monkeypatch.setattr(X, "OFTEN", 3)
    assert [g[1] for g in run(spark, texts, 40)] == brute(texts, 40)


def test_stride(monkeypatch):
    rng = np.random.default_rng(2)
    t = X.Text(np.concatenate((rng.integers(97, 100, 900, dtype=np.uint8), np.full(300, 97, np.uint8))))
    whole = {(p, s) for p, near, far in zip(*[x.tolist() for x in X.anchors(t, 64, 0, 1137)[:3]]) for s in range(p - far, p - near + 1)}
    assert {s for _, s in whole} == set(range(1137)) and len(whole) == 1137
    parts = set()
    for lo in range(0, 1137, 100):
        parts |= {(p, s) for p, near, far in zip(*[x.tolist() for x in X.anchors(t, 64, lo, min(lo + 100, 1137))[:3]]) for s in range(p - far, p - near + 1)}
    assert parts == whole




def test_query(spark, tmp_path):
    long = " ".join(f"sentence {k} of a text that is long enough" for k in range(40))
    rows = [doc(i, t) for i, t in enumerate(EDGE_TEXTS)] + [doc(50, long), doc(51, "x" + long[:700]), doc(52, long[:399]), doc(53, "é" * 300), doc(53, "é" * 300), doc(None, "y" + long[100:900])]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 9000]
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for (i, *_), t, runs in zip(rows, texts, brute(texts, 400)):
        kept = bytes(c for k, c in enumerate(t) if not any(s <= k < e for s, e in runs))
        want.append((i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in X.op3_repeated_text(spark, save(spark, tmp_path, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert X.op3_repeated_text(spark, save(spark, tmp_path, [])).count() == 0


def brute_by_hash(texts, length):
    """The runs of each text, from hashes of all windows, which are put together by doubling."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    base, n = 0xD1342543DE82EF95, len(whole)
    power = lambda k: np.uint64(pow(base, k, 2**64))
    one, width, done, h = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64)[whole] * np.uint64(2) + np.uint64(1), 1, 0, np.zeros(n, np.uint64)
    for k in range(length.bit_length()):
        if length >> k & 1:
            h[: n - done] = h[: n - done] * power(width) + one[done:]
            done += width
        one[: n - width] = one[: n - width] * power(width) + one[width:]
        width *= 2
    start = np.concatenate([np.arange(e - len(t), max(e - len(t), e - length + 1)) for t, e in zip(texts, ends)])
    _, at, count = np.unique(h[start] ^ (h[start] >> np.uint64(31)), return_inverse=True, return_counts=True)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start[count[at] > 1], 1)
    np.add.at(cover, start[count[at] > 1] + length, -1)
    cover = np.cumsum(cover[:-1]) > 0
    out = []
    for t, e in zip(texts, ends):
        edge = np.flatnonzero(np.diff(cover[e - len(t) : e].astype(np.int8), prepend=0, append=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def test_very_long_text(spark, tmp_path):
    """Texts of more windows than are looked at together, with passages across the border."""
    rng = np.random.default_rng(12)
    long = rng.integers(97, 123, X.STRIDE + 300_000, dtype=np.uint8).tobytes().decode()
    other = rng.integers(97, 123, X.STRIDE + 5000, dtype=np.uint8).tobytes().decode()
    other = long[X.STRIDE - 250 : X.STRIDE + 700] + other[:-300] + long[-1300:-900] + long[5:404] + long[X.STRIDE // 2 : X.STRIDE // 2 + 401]
    rows = [doc(i, t) for i, t in enumerate(EDGE_TEXTS)] + [doc(90, long), doc(91, other), doc(92, "é" + long[:400]), doc(93, long[100:499])]
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for (i, *_), t, runs in zip(rows, texts, brute_by_hash(texts, 400)):
        kept = t
        for s, e in reversed(runs):
            kept = kept[:s] + kept[e:]
        want.append((i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    assert [w[3] for w in want[-4:]] == [4, 3, 1, 0]
    assert sorted(map(tuple, X.op3_repeated_text(spark, save(spark, tmp_path, rows)).collect())) == sorted(want)


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words in two documents each: of 400 bytes or more they go whole, shorter ones stay, and
    n_bytes is the size of the input either way."""
    rng = random.Random(51)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    def passage(words, size):
        gaps = set(rng.sample(range(1, size - 1, 2), words - 1))
        return "".join(" " if k in gaps else letters(1) for k in range(size))

    cases = [(51, 326), (51, 399), (51, 400), (63, 399), (63, 400), (63, 401), (120, 399), (120, 760)]
    rows, want = [], []
    for words, size in cases:
        p = passage(words, size)
        assert len(p.split()) == words and len(p.encode()) == size
        for a, b in ("<>", "()"):
            text = f"{letters(300)}{a}{p}{b}{letters(200)}"
            kept = text.replace(p, "") if size >= 400 else text
            rows.append(doc(len(rows), text))
            want.append((len(want), len(text), len(text) - len(kept), int(size >= 400), hashlib.sha256(kept.encode()).hexdigest()))
    for _ in cases:
        rows.append(doc(len(rows), passage(130, 901)))
        want.append((len(want), 901, 0, 0, hashlib.sha256(rows[-1][1].encode()).hexdigest()))
    assert sorted(map(tuple, X.op3_repeated_text(spark, save(spark, tmp_path, rows)).collect())) == want


def test_sample(spark):
    rows = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r) for r in X.op3_repeated_text(spark, SF).collect()}
    for (i, t), runs in zip(rows, brute([t for _, t in rows], 400)):
        kept, last = [], 0
        for s, e in runs:
            kept.append(t[last:s])
            last = e
        kept = b"".join([*kept, t[last:]])
        assert got[i] == (i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    assert len(got) == len(rows)


def test_texts_stay_in_place(spark):
    """After the first round no pack is dealt again."""
    df = spark.createDataFrame([(1, "a" * 500), (2, "a" * 500)], "doc_id long, text string")
    plan = X._repeats(df, 400, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pack") == 1
