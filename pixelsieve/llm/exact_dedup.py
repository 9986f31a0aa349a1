"""Exact duplicates by content-defined chunk recipes.

One pass over the texts turns each normalised text (every character of ``[\\x20\\x09-\\x0D]`` deleted) into
an ordered list of content-defined chunks. Only chunk fingerprints leave that pass: no text is shuffled,
however long it is. Chunks with one 64-bit fingerprint are told apart by 128 bits of SHA-256, so that an
identifier (fingerprint, variant) stands for one chunk content; two documents are equal when their ordered
identifier lists are.

Defined results: null text counts as empty; all texts that are empty after normalising are one group;
repeated rows (equal id and text) are members like others and share the ``kept`` of their id; ties go to the
smallest id (null ids come last); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, cut, pick, read, tidied, unique_names, utf8_views

WHITESPACE = bytes([9, 10, 11, 12, 13, 32])
#: A chunk ends where the mixed sum of the last WINDOW table values has MASK's bits all zero: 4 KiB on average.
WINDOW = 32
MASK_BITS = 12
MAX_CHUNK = 1 << 16

_TABLE = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_SCAN = "id long, n_chars long, sha string, chunks array<struct<pos:int,h:long,d1:long,d2:long>>"
_CHUNK = pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])


def boundaries(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of data; the last is its length."""
    n = len(data)
    ends: list[int] = []
    if n > WINDOW:
        sums = np.cumsum(_TABLE[np.frombuffer(data, np.uint8)], dtype=np.uint32)
        mixed = sums[WINDOW:] - sums[:-WINDOW]
        mixed *= np.uint32(2654435769)
        ends = (np.flatnonzero(mixed >> np.uint32(32 - MASK_BITS) == 0) + WINDOW + 1).tolist()
    out, last = [], 0
    for e in [*ends, n]:
        while e - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def _signed(b: bytes) -> int:
    return int.from_bytes(b, "little", signed=True)


def chunks_of(data: bytes) -> list[tuple[int, int, int, int]]:
    """(position, 64-bit fingerprint, two halves of a 128-bit digest) of each chunk."""
    out, last = [], 0
    for k, e in enumerate(boundaries(data)):
        part = data[last:e]
        last = e
        digest = hashlib.sha256(part).digest()
        out.append((k, _signed(xxhash.xxh3_64_digest(part)), _signed(digest[:8]), _signed(digest[8:16])))
    return out


@tidied
def _scan(batches):
    names, types = ["id", "n_chars", "sha", "chunks"], [pa.int64(), pa.int64(), pa.string(), pa.list_(_CHUNK)]
    for b in batches:
        shas, chunks = [], []
        for view in utf8_views(b.column("text")):
            data = bytes(view).translate(None, WHITESPACE)
            shas.append(hashlib.sha256(data).hexdigest())
            chunks.append([dict(zip(("pos", "h", "d1", "d2"), c, strict=True)) for c in chunks_of(data)])
        yield batch(names, types, [b.column("id"), b.column("n_chars"), shas, chunks])


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_chars (code points of the original), sha (of the normalised text),
    copies of that very row, and recipe, its ordered list of verified chunk identifiers."""
    src = pick(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    scanned = cut(src.mapInArrow(_scan, _SCAN))
    key = ["id", "n_chars", "sha"]
    parts = scanned.select(*key, F.explode("chunks").alias("c")).select(*key, "c.*")
    # The identifiers: a fingerprint with one digest is variant 1; others are numbered by digest.
    seen = parts.groupBy("h", "d1", "d2").agg(F.count("*").alias("n_seen"))
    by_digest = "row_number() over (partition by h order by d1, d2) as v"
    known = seen.select("h", "d1", "d2", F.expr(by_digest))
    named = parts.join(known, ["h", "d1", "d2"]).select(*key, F.struct("pos", "h", "v").alias("c"), F.lit(0).alias("row"))
    rows = scanned.select(*key, F.lit(None).cast(named.schema["c"].dataType).alias("c"), F.lit(1).alias("row"))
    return (
        named.unionByName(rows)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("c")).alias("c"), F.sum("row").alias("copies"))
        .select(*key, "copies", F.transform("c", lambda x: F.struct(x["h"].alias("h"), x["v"].alias("v"))).alias("recipe"))
    )


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal normalised texts: id, keep_id, group_size, kept, text_sha256; a row for each input row.

    Of a group stays the row with the most code points in its original text, then the smallest id."""
    r = cut(recipes(df, id_col, text_col))
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))
    groups = r.groupBy("recipe").agg(F.min(order).alias("best"), F.sum("copies").alias("group_size"))
    # Written first, as the join below is then one of two plain shuffles, in which a very common recipe is split.
    groups = cut(groups.select(F.col("recipe").alias("of"), F.col("best.id").alias("keep_id"), F.col("best.n").alias("best_n"), "group_size"))
    joined = r.join(groups, F.col("recipe") == F.col("of"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (-F.col("n_chars") == F.col("best_n"))
    return joined.select("id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy")).drop("copy")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal normalised texts, all its columns kept."""
    df, restore = unique_names(df)
    r = recipes(df, id_col, text_col)
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), "sha", "copies")
    best = cut(r.groupBy("recipe").agg(F.min(order).alias("best")).select((-F.col("best.n")).alias("__n"), F.col("best.id").alias("__id"), F.col("best.sha").alias("__sha"), F.col("best.copies").alias("__copies")))
    text = F.coalesce(df[text_col], F.lit(""))
    sha = F.sha2(F.encode(F.translate(text, " \t\n\x0b\x0c\r", ""), "UTF-8"), 256)
    on = lambda b: df[id_col].cast("long").eqNullSafe(b["__id"]) & (F.length(text) == b["__n"]) & (sha == b["__sha"])
    once, often = best.filter("__copies = 1"), best.filter("__copies > 1")
    single, repeated = df.join(once, on(once), "left_semi"), df.join(often, on(often), "left_semi")
    return restore(single.unionByName(repeated.dropDuplicates([id_col, text_col])))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents),
g AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
