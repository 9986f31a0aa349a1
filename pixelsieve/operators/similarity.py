"""Similarity joins, nearest neighbours and groups of equal hashes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelsieve.functions import metrics

#: Rows up to which nearest() without a key sends the table to all executors; it refuses larger ones.
BROADCAST_ROWS = 50_000
#: Distinct hashes for which a join's bands are laid out, and the cost of a key in candidates that are compared.
EXPECTED, KEY_COST = 1_000_000, 4
#: Bits of a band at most, as its key is a long.
WIDEST = 60


@dataclass(frozen=True)
class Bands:
    """Bands of a binary hash, from bit lows[k] to lows[k + 1]. Of two hashes that differ in at most `threshold` bits,
    one band differs in at most `flips` bits, as the bands are more than threshold / (flips + 1)."""

    lows: tuple[int, ...]
    flips: int

    @property
    def widths(self) -> list[int]:
        return [b - a for a, b in itertools.pairwise(self.lows)]

    def masks(self, k: int) -> list[int]:
        """What turns a band's value into those within `flips` bits."""
        return [sum(1 << i for i in some) for n in range(self.flips + 1) for some in itertools.combinations(range(self.widths[k]), n)]

    def cost(self, hashes: int) -> float:
        reach = [sum(math.comb(w, n) for n in range(self.flips + 1)) for w in self.widths]
        return hashes * KEY_COST * sum(reach) + hashes**2 / 2 * sum(r / 2**w for r, w in zip(reach, self.widths, strict=True))

    def values(self, hash_: Column) -> Column:
        """The bands of a hash (array of bytes, lowest bit first) as longs."""
        out = []
        for lo, hi in itertools.pairwise(self.lows):
            value = F.lit(0).cast("long")
            for byte in range(lo // 8, (hi + 7) // 8):
                first, last = max(lo - 8 * byte, 0), min(hi - 8 * byte, 8)
                part = F.shiftright(F.element_at(hash_, byte + 1).cast("long"), first).bitwiseAND(F.lit((1 << (last - first)) - 1))
                value = value.bitwiseOR(F.shiftleft(part, 8 * byte + first - lo))
            out.append(value)
        return F.array(*out)

    def reached(self, values: str) -> Column:
        """Band and value (at, value) of all that a few flipped bits of a column of bands give."""
        def of(k: int) -> Column:
            # literal masks, written as text, as there may be thousands of them
            masks = F.expr(f"cast(split('{','.join(map(str, self.masks(k)))}', ',') as array<bigint>)")
            return F.transform(masks, lambda m: F.struct(F.lit(k).alias("at"), F.element_at(values, k + 1).bitwiseXOR(m).alias("value")))

        return F.concat(*map(of, range(len(self.widths))))

    def first(self, a: str, b: str) -> Column:
        """The first band in which two columns of bands meet."""
        return F.array_position(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= self.flips), F.lit(True)) - 1


def lay_out(length: int, threshold: int, expected: int = EXPECTED) -> Bands:
    """The cheapest bands for hashes of `length` bytes: with more flips to try there are fewer and longer bands, so
    more keys of a hash, but fewer candidates of a key."""
    total = 8 * length
    if threshold >= total:
        raise ValueError("the threshold is as large as the hash")
    found = []
    for flips in range(3):
        count = max(threshold // (flips + 1) + 1, -(-total // WIDEST))
        if count <= total:
            found.append(Bands(tuple(k * total // count for k in range(count + 1)), flips))
    return min(found, key=lambda x: x.cost(min(expected, 2 ** min(total, 60))))


def classes(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """A row for each distinct hash: h, id (the smallest of its rows), size. Counts are combined before the shuffle."""
    return df.groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"), F.count("*").alias("size"))


def hamming_join(df: DataFrame, id_col: str, hash_col: str, length: int, threshold: int, expand: bool = False, expected: int = EXPECTED) -> DataFrame:
    """Pairs of hashes that differ in at most `threshold` bits, with their distance: id_a, id_b, distance.

    Exact: candidates come from an equi join on bands, never from all pairs. One side has a key for each band, the
    other one for each value that a few flipped bits of the band can give (`lay_out`, for about `expected` distinct
    hashes), so that keys stay long where the threshold is large. A pair that several bands bring is kept in the
    first of them alone, so that no distinct is needed. Very common bands are split by adaptive execution, as the
    join is a plain one. Rows with one hash are one class, which its smallest id stands for; with expand, every pair
    of rows (id_a < id_b) is returned instead, also those of one class, whose number is the square of its size."""
    bands = lay_out(length, threshold, expected)
    rows = classes(df, id_col, hash_col)
    keyed = rows.select("id", metrics.packed(F.col("h")).alias("words"), bands.values(F.col("h")).alias("bands"))
    a = keyed.select(F.col("id").alias("id_a"), F.col("words").alias("wa"), F.col("bands").alias("ba"), F.posexplode("bands").alias("at", "value"))
    b = keyed.select(F.col("id").alias("id_b"), F.col("words").alias("wb"), F.col("bands").alias("bb"), F.explode(bands.reached("bands")).alias("x")).select("id_b", "wb", "bb", "x.at", "x.value")
    near = a.join(b, ["at", "value"]).where(F.col("id_a") < F.col("id_b"))
    near = near.withColumn("distance", metrics.hamming_packed(F.col("wa"), F.col("wb"))).where(F.col("distance") <= threshold)
    near = near.where(bands.first("ba", "bb") == F.col("at")).select("id_a", "id_b", "distance")
    if not expand:
        return near
    # Rows by the class that stands for them; a class of one row is that row.
    of = df.join(rows.where("size > 1").select(F.col("h").alias("held"), F.col("id").alias("of")), F.col(hash_col) == F.col("held")).select("of", F.col(id_col).alias("row"))
    side = lambda x, pairs: pairs.join(of.select(F.col("of").alias("c"), F.col("row").alias(f"row_{x}")), F.col(f"id_{x}") == F.col("c"), "left").withColumn(f"id_{x}", F.coalesce(f"row_{x}", f"id_{x}")).drop("c", f"row_{x}")
    other = side("b", side("a", near))
    same = of.join(of.select("of", F.col("row").alias("other")), "of").where("row < other").select(F.col("row").alias("id_a"), F.col("other").alias("id_b"), F.lit(0.0).alias("distance"))
    return other.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance").unionByName(same)


def pairs_within(df: DataFrame, key: str, id_col: str, columns: list[str]) -> DataFrame:
    """Pairs (id_a < id_b) of rows with one key, with the columns of both as <name>_a and <name>_b."""
    side = lambda s: df.select(F.col(key).alias("key" if s == "a" else "key_b"), F.col(id_col).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side("a").join(side("b"), (F.col("key") == F.col("key_b")) & (F.col("id_a") < F.col("id_b"))).drop("key_b")


#: Rows of a block whose pairs with another block are compared together.
BLOCK = 2000


def compared_within(df: DataFrame, key: str, id_col: str, column: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int, block: int = BLOCK) -> DataFrame:
    """Pairs (id_a < id_b) of rows with one key, and their distance, rounded as Spark rounds: id_a, id_b, distance.

    Every pair is compared, by any symmetric kernel from two matrices of vectors to the matrix of their distances. The rows
    of a key are dealt to blocks, and each two blocks of it (and each one with itself) are a task's unit, so that a
    common key is spread over all cores and a pair's vectors are never a row. Each row goes to as many units as its
    key has blocks. Ids are longs; rows without key or id have no pairs, null vectors a null distance."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")).where("key is not null and id is not null")
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("key", "of")
    rows = rows.join(blocks, F.col("key") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, mine) as lo, greatest(x, mine) as hi))")
    dealt = rows.select("key", "id", "v", "mine", F.explode(units).alias("u")).select("key", "id", "v", "u.lo", "u.hi", (F.col("mine") == F.col("u.hi")).alias("high"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(tasks, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_units(kernel, digits), "id_a long, id_b long, distance double")


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: half up, of the shortest decimal that stands for the value."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**digits
        whole = np.rint(scaled)
        # Products near a half are settled in decimals, and so are those of more digits than a double has.
        unsure = ~(np.abs(np.abs(scaled - whole) - 0.5) > np.maximum(1e-6, np.abs(scaled) * 1e-15)) | ~(np.abs(scaled) < 2.0**50)
        out = whole / 10.0**digits
    for k in np.flatnonzero(unsure).tolist():
        v = float(x[k])
        out[k] = float(Context(prec=400, rounding=ROUND_HALF_UP).quantize(Decimal(repr(v)), Decimal(1).scaleb(-digits))) if np.isfinite(v) else v
    return out + 0.0


def _units(kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int):
    def compare(a: list, b: list, within: bool) -> Iterator[pa.RecordBatch]:
        """Rows of a with rows of b; within: a is b."""
        groups: dict[tuple, tuple[list, list]] = {}
        for side, rows in ((0, a), (1, b)):
            for k, (_, v) in enumerate(rows):
                groups.setdefault((side, -1 if v is None else len(v)), ([], []))[0].append(k)
        ids = [np.array([r[0] for r in rows], np.int64) for rows in (a, b)]
        for (side, n), (at, _) in groups.items():
            for (other, m), (to, _) in groups.items():
                if side or not other:
                    continue
                x, y = ids[0][at], ids[1][to]
                values = None if n < 0 or m < 0 else (np.stack([a[k][1] for k in at]), np.stack([b[k][1] for k in to]))
                for lo in range(0, len(at), 250):  # of a matrix's rows
                    left = x[lo : lo + 250]
                    keep = left[:, None] < y[None, :] if within else left[:, None] != y[None, :]
                    i, j = np.nonzero(keep)
                    if not len(i):
                        continue
                    first, second = left[i], y[j]
                    if values is None:
                        distance = pa.nulls(len(i), pa.float64())
                    else:
                        distance = pa.array(rounded(kernel(values[0][lo : lo + 250], values[1])[i, j], digits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second)), distance], names=["id_a", "id_b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            within = now is not None and now[1] == now[2]
            yield from compare(sides[1], sides[1], True) if within else compare(*sides, False)

        for batch in batches:
            vectors = batch.column("v")
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
            valid = vectors.is_valid().to_pylist()
            for k, (unit, row, high) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True), batch.column("id").to_pylist(), batch.column("high").to_pylist(), strict=True)):
                if unit != now:
                    yield from done()
                    now, sides = unit, ([], [])
                sides[high].append((row, flat[offsets[k] : offsets[k + 1]] if valid[k] else None))
        yield from done()

    return run


def _ranked(both: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(df: DataFrame, id_col: str, hash_col: str, k: int, distance: Callable[[Column, Column], Column], key: str | None = None) -> DataFrame:
    """The k nearest other rows of each row, ties by id: id, neighbour, distance, rank. With key, of rows that
    share it. Ranks are cut to k before the shuffle of the window.

    Any metric, so all pairs of a key are compared; keys should be small groups. Without a key, that is refused for
    tables of more than BROADCAST_ROWS rows: binary hashes have nearest_within()."""
    cols = [F.col(id_col).alias("id"), F.col(hash_col).alias("h")] + ([F.col(key).alias("key")] if key else [])
    a = df.select(*cols)
    b = df.select(F.col(id_col).alias("neighbour"), F.col(hash_col).alias("g"), *([F.col(key).alias("key")] if key else []))
    if key:
        both = a.join(b, "key")
    else:
        if b.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            raise ValueError(f"comparing all pairs of more than {BROADCAST_ROWS} rows: give a key, or use nearest_within()")
        both = a.join(F.broadcast(b))  # of a checked size
    both = both.where(F.col("id") != F.col("neighbour")).select("id", "neighbour", distance(F.col("h"), F.col("g")).alias("distance"))
    return _ranked(both, k)


def nearest_within(df: DataFrame, id_col: str, hash_col: str, length: int, k: int, threshold: int, expected: int = EXPECTED) -> DataFrame:
    """The k nearest other rows, of those within `threshold` bits, of each row of a table of any size, ties by id: id,
    neighbour, distance, rank. By hamming_join(); rows with no other one within the threshold have no row."""
    pairs = hamming_join(df, id_col, hash_col, length, threshold, expand=True, expected=expected)
    both = pairs.select(F.explode(F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("neighbour"), "distance"), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("neighbour"), "distance"))).alias("x"))
    return _ranked(both.select("x.*"), k)


def equal_groups(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """The groups of rows with one hash: smallest id, size."""
    return df.groupBy(hash_col).agg(F.min(id_col).alias("first_id"), F.count("*").alias("size"))
