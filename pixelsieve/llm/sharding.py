"""Proportional stratified interleaving, with DataFrame functions alone.

Rows of each source are put in a seeded shuffle order; row r of a source of n rows gets the fractional rank
``(r + u) / n``, where u in (0, 1) is a fixed offset of the source (so that sources of one row spread out).
Sorted by fractional rank, every run of rows holds each source in its share of the corpus, so that cutting
the order into equal counts gives shards that match the mixture (law ``rows``: counts at most one apart).

No window spans a source or the table: a row's rank is the number of rows in earlier hash buckets of its
source, from counts, plus its rank in its bucket; likewise for the order of fractional ranks. A source with a
third of all rows is thus spread over BUCKETS windows.

Defined results: null or empty text has size 1; a null source is a source of its own; ties of the shuffle
order are broken by id and the columns named as ties, and rows that are equal in all of these take neighbouring
ranks, so that the order of rows that differ in a tie column doesn't hang on where they come from; an empty
table gives no rows; input columns named shard or slot are replaced, and of columns with one name the second
and later ones get another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelsieve.llm.common import read, unique_names

SEED = 17
#: Windows for each source, and for the whole order: a power of 16, as buckets are leading hex digits.
BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS


def _hash(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def interleave(df: DataFrame, n_shards: int, *, id_col: str = "doc_id", source_col: str = "source", ties: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    df, _ = unique_names(df)
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    # The input's columns travel in one, so that none can clash with those below.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(source_col).alias("__s"), _hash(F.lit(seed), F.col(id_col)).alias("__h"), F.col(id_col).alias("__i"), *[F.col(t).alias(f"__z{k}") for k, t in enumerate(ties)])
    rows = rows.withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    order = ["__h", "__i", *[f"__z{k}" for k in range(len(ties))]]
    # Rank in the source: rows of its earlier buckets, and the rank in the bucket.
    count = rows.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    by_source = Window.partitionBy("__s")
    before = count.select(
        F.col("__s").alias("__cs"),
        F.col("__b").alias("__cb"),
        (F.sum("__n").over(by_source.orderBy("__b")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(by_source).alias("__of"),
    )
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy(*order)) - 1)
    ranked = ranked.join(before, F.col("__s").eqNullSafe(F.col("__cs")) & (F.col("__b") == F.col("__cb")))
    start = (F.conv(F.substring(_hash(F.lit("source"), F.lit(seed), F.col("__s")), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(2.0**32)
    ranked = ranked.withColumn("__f", (F.col("__before") + F.col("__r") + start) / F.col("__of"))
    ranked = ranked.withColumn("__fb", F.floor(F.col("__f") * BUCKETS))
    # Place in the whole order, in the same way; at most BUCKETS counts are summed up.
    whole = ranked.groupBy("__fb").agg(F.count("*").alias("__n"))
    upto = whole.select(
        F.col("__fb").alias("__cfb"),
        (F.sum("__n").over(Window.orderBy("__fb")) - F.col("__n")).alias("__ahead"),
        F.sum("__n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"),
    )
    placed = ranked.withColumn("__p", F.row_number().over(Window.partitionBy("__fb").orderBy("__f", *order)) - 1)
    # upto has at most BUCKETS rows, whatever the input.
    placed = placed.join(F.broadcast(upto), F.col("__fb") == F.col("__cfb")).withColumn("__p", F.col("__ahead") + F.col("__p"))
    placed = placed.withColumn("shard", F.expr(f"cast(__p * {n_shards} div __all as int)"))
    first = F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", F.col("__p") - first).select("row.*", "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleave(rows, 16, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP2_SQL = r"""
WITH k AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS x,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
c AS (
  SELECT doc_id, source, size, h, xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(range(size - 1), lambda i: ('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)),
    lambda a, b: xor(a >> 8, crc[CAST((xor(a, b) & 255) + 1 AS INTEGER)]))) AS text_crc32
  FROM d, k),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n,
         (('0x' || substr(md5('source:17:' || coalesce(source, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM c),
p AS (
  SELECT *, row_number() OVER (ORDER BY (r + u) / n, h, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p * 16 // total)::INTEGER AS shard,
       p - ((p * 16 // total) * total + 15) // 16 AS slot, NULL::INTEGER AS grown_shard
FROM p
"""
