"""Document fingerprints by Order MinHash.

The k-mers of a text are numbered by occurrence, so that a repeated k-mer counts as often as it occurs. Each of
SKETCHES hash functions selects the TUPLE numbered k-mers with the smallest values, puts them back into text
order, and hashes the k-mers as that tuple. Moving text about changes order and with it the tuples, so that the
share of equal parts of two fingerprints follows the edit distance, where a set-based sketch would not.

Defined results: null text counts as empty; a text shorter than K is its own only k-mer; empty texts have equal
fingerprints, of no k-mer; equal texts have equal fingerprints; of two k-mers with one value the earlier is
taken; an empty table gives no rows; other columns are not read. In the order of ids null comes first, and
rows of one id follow each other by their texts' hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, pick, read, tidied

K = 8
SKETCHES = 64
TUPLE = 2
#: Ranges of ids that are sorted on their own, for each shuffle partition.
RANGES = 4

_rng = np.random.default_rng(881)
_MULTIPLY = (_rng.integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_MASK = _rng.integers(0, 2**32, SKETCHES, dtype=np.uint32)
_POWERS = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 21


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def numbered_kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the text, the hash of its k-mer and of the k-mer with its occurrence number."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    if n < K:
        codes = np.concatenate((codes, np.full(K - n, 0x110000 + n, np.uint64)))
    count = len(codes) - K + 1
    h = np.zeros(count, np.uint64)
    for j in range(K):
        h += (codes[j : j + count] + np.uint64(1)) * _POWERS[j]
    kmers = (_mix(h) >> np.uint64(32)).astype(np.uint32)
    # Equal k-mers side by side, in text order: the place in the run is the occurrence number.
    at = np.sort(kmers.astype(np.uint64) << np.uint64(32) | np.arange(count, dtype=np.uint64))
    value, place = (at >> np.uint64(32)).astype(np.uint32), (at & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    occurrence = np.arange(count) - np.repeat(starts, np.diff(np.concatenate((starts, [count]))))
    numbered = np.empty(count, np.uint32)
    numbered[place] = (_mix(value.astype(np.uint64) * _GOLDEN + occurrence.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    return kmers, numbered


def _smallest(numbered: np.ndarray) -> np.ndarray:
    """Places of the TUPLE smallest values for each hash function, in text order; a block of places at a time."""
    n = len(numbered)
    width = max(TUPLE, _BLOCK // SKETCHES)
    if n > width:
        parts = [_smallest(numbered[lo : lo + width]) + lo for lo in range(0, n, width)]
        places = np.concatenate(parts, axis=1)
        values = _values(numbered[places], rows=True)
        best = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
        return np.sort(np.take_along_axis(places, best, axis=1), axis=1)
    values = _values(numbered)
    take, rows = min(TUPLE, n), np.arange(SKETCHES)
    out = np.empty((SKETCHES, take), np.int64)
    for t in range(take):
        out[:, t] = values.argmin(axis=1)
        if t + 1 < take:
            values[rows, out[:, t]] = 0xFFFFFFFF
    return np.sort(out, axis=1)


def _values(numbered: np.ndarray, rows: bool = False) -> np.ndarray:
    x = (numbered if rows else numbered[None, :]) ^ _MASK[:, None]
    x = x * _MULTIPLY[:, None]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


def sketch(text: str) -> np.ndarray:
    """SKETCHES 16-bit parts."""
    kmers, numbered = numbered_kmers(text)
    if not len(kmers):
        return np.zeros(SKETCHES, np.uint16)
    places = _smallest(numbered)
    h = np.full(SKETCHES, np.uint64(len(places[0])), np.uint64)
    for t in range(places.shape[1]):
        h = _mix(h * _GOLDEN + kmers[places[:, t]].astype(np.uint64) + np.uint64(1))
    return (h >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def to_string(parts: np.ndarray) -> str:
    return parts.astype(">u2").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (hex); a row for each input row."""

    def run(batches):
        for b in batches:
            said = [to_string(sketch(t or "")) for t in b.column("text").to_pylist()]
            yield batch(["id", "fingerprint"], [pa.int64(), pa.string()], [b.column("id"), said])

    rows = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(tidied(run), "id long, fingerprint string")


def _number_below(points: list[int], column: str):
    """How many of the ascending points are below a column's value, by halving steps."""
    if not points:
        return F.lit(0)
    n = len(points)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    known = f"cast(split('{','.join(map(str, points))}', ',') as array<bigint>)"
    step = f"if(at + step <= {n} and element_at({known}, least(at + step, {n})) < {column}, at + step, at)"
    return F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> {step})")


def in_order_with_next(df: DataFrame, fn, schema: str, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """fn over an iterator of (id, text, next text) in ascending order of id, the last followed by the first.

    Ids are dealt to ranges at given percentiles (RANGES for each shuffle partition); a range's last row needs the
    first row of the next range, so that row is copied to the range before. Texts move once, and no task sorts
    more than its ranges, which get no larger as the input and with it the number of partitions grow."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(64, RANGES * tasks)
    rows = pick(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    points = rows.select(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    points = sorted(set(points))
    rows = rows.withColumn("bucket", F.coalesce(_number_below(points, "id"), F.lit(0))).withColumn("tie", F.xxhash64("text"))
    least = rows.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("n"), "id", "tie")).alias("first"))
    firsts = sorted((r["bucket"], r["first"]["n"], r["first"]["id"], r["first"]["tie"]) for r in least.collect())  # at most `ranges` rows
    before = {b: firsts[k - 1][0] for k, (b, *_) in enumerate(firsts)}
    copies = df.sparkSession.createDataFrame(
        [(n, i if n else 0, t, before[b], k == 0) for k, (b, n, i, t) in enumerate(firsts)], "n boolean, i long, t long, to int, wraps boolean"
    )
    same = (F.col("id").isNotNull() == F.col("n")) & (F.coalesce("id", F.lit(0)) == F.col("i")) & (F.col("tie") == F.col("t"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    copied = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("copy"))
    joined = rows.join(F.broadcast(copies), same, "left")  # at most `ranges` rows
    dealt = joined.select("id", "text", "tie", F.explode(F.when(F.col("to").isNotNull(), F.array(own, copied)).otherwise(F.array(own))).alias("where"))
    dealt = dealt.select("id", "text", "tie", "where.bucket", "where.copy")
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "copy", "id", "tie")

    def stream(batches):
        held = None  # the row that waits for its next
        for b in batches:
            for i, text, bucket, copy in zip(*(b.column(c).to_pylist() for c in ("id", "text", "bucket", "copy")), strict=True):
                if held is not None and held[2] == bucket:
                    yield held[0], held[1], text
                held = None if copy else (i, text, bucket)
                # further copies of one first row find nothing held

    def run(batches):
        yield from fn(stream(batches))

    return dealt.mapInArrow(tidied(run), schema)


def _pairs(rows):
    """Digest rows, a few at a time."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out, known = [], (None, None)
    for i, text, following in rows:
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        own = known[1] if known[0] == text else sketch(text)
        other = sketch(following)
        known = (following, other)
        changed = sketch(edited)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), to_string(own), to_string(changed), likeness(own, changed), likeness(own, other)))
        if len(out) == 1000:
            yield batch(names, types, list(zip(*out, strict=True)))
            out = []
    if out:
        yield batch(names, types, list(zip(*out, strict=True)))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_next(read(spark, sf_dir, "documents"), _pairs, schema)
