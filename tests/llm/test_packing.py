import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import EDGE_TEXTS, SF, doc, save
from tokenizers import Tokenizer

from pixelsieve.llm import bpe, packing


def expand(runs):
    bins = defaultdict(list)
    for r in runs:
        for k in range(r.bins * r.each):
            bins[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    return bins


def best_fit(lengths, capacity):
    """Plain best-fit decreasing; its number of bins."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        g = min(fits) if fits else None
        if g is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(g)] = g - x
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_counts(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 256])
    top = rng.choice([capacity, capacity // 2 + 1, capacity // 3 + 1])
    lengths = [rng.randint(1, top) for _ in range(rng.choice([1, 5, 60, 400]))]
    runs, n = packing.pack_counts(Counter(lengths), capacity)
    bins = expand(runs)
    assert len(bins) == n and sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
    for b in bins.values():
        at = 0
        for offset, x in sorted(b):
            assert offset == at
            at += x
        assert at <= capacity and sum(x > capacity // 3 for _, x in b) <= 2
    for x in set(lengths):
        ranks = sorted((r.first, r.first + r.bins * r.each) for r in runs if r.length == x)
        assert ranks[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))
    assert n <= best_fit(lengths, capacity) * 1.05 + 1
    assert n >= packing.lower_bound(sum(lengths), capacity)


def test_empty():
    assert packing.pack_counts({}, 10) == ([], 0)


def check(rows, got, capacity=packing.CAPACITY):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(bins) <= packing.lower_bound(total, capacity) * 1.1 + 2


def test_edges(spark, tmp_path):
    rows = [doc(i, t) for i, t in enumerate(EDGE_TEXTS)] + [doc(5, "again"), doc(5, "again"), doc(60, "<|endoftext|> a" * 3), doc(None, "no id")]
    check([(r[0], r[1]) for r in rows], packing.op4_packing(spark, save(spark, tmp_path, rows)).collect())
    assert packing.op4_packing(spark, save(spark, tmp_path, [])).count() == 0


def test_sample(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, packing.op4_packing(spark, SF).collect())


def test_too_long(spark):
    df = spark.createDataFrame([(1, 0, 0, 9, 0)], "id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(ValueError):
        packing.place(df, capacity=8)
