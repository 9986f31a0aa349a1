"""Best-fit packing with large-item matching.

Documents longer than a third of the capacity fit at most twice in a bin: from the longest down, each is
matched with the longest other one that still fits beside it. The rest, from the longest down, goes where it
leaves the smallest gap, and opens a new bin where no gap is left.

Lengths are at most the capacity, so the whole input is described by how many documents each length has. The
driver packs these counts, at most `capacity` numbers whatever the input, many equal bins at a time. The
result is a list of runs: the documents of one length with ranks a to b go to such bins at such offsets. A
document needs only its rank among those of its length, which comes from counts by hash bucket and a rank in
the bucket; buckets grow in number with the most common length, so that it is no hot spot.

Defined results: null and empty texts are the end token alone (length 1); longer documents are cut into
capacity-sized pieces, the last may be shorter; repeated rows are packed each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelsieve.llm import bpe
from pixelsieve.llm.common import batch, cut, pick, read, remember_for, slices, tidied

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are ranked in so many buckets at least, and in more where a bucket would hold over RANK_ROWS.
RANK_BUCKETS, RANK_ROWS = 256, 20_000
#: Words whose ids a worker remembers, in two generations.
REMEMBERED = 1_200_000

_PIECES = "id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Run:
    """Documents of one length with ranks first to first + bins * each - 1: `each` in every one of the bins
    from sequence `sequence` on, one after the other from `offset`."""

    length: int
    first: int
    bins: int
    each: int
    sequence: int
    offset: int


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs for the number of documents of each length, and the number of bins."""
    left = dict(counts)
    gaps: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # gap: (number of bins, ((length, each), ...))
    large = capacity // 3
    lengths = sorted((x for x in left if x > large), reverse=True)
    ascending = lengths[::-1]
    for x in lengths:
        while left[x]:
            # the longest that fits beside x, of those not longer than x
            k = bisect.bisect_right(ascending, min(capacity - x, x)) - 1
            while k >= 0 and left[ascending[k]] < (2 if ascending[k] == x else 1):
                k -= 1
            if k < 0:
                gaps[capacity - x].append((left[x], ((x, 1),)))
                left[x] = 0
            elif ascending[k] == x:
                gaps[capacity - 2 * x].append((left[x] // 2, ((x, 2),)))
                left[x] %= 2
            else:
                y = ascending[k]
                t = min(left[x], left[y])
                gaps[capacity - x - y].append((t, ((x, 1), (y, 1))))
                left[x] -= t
                left[y] -= t
    open_gaps = sorted(gaps)

    def put(gap: int, bins: int, items: tuple) -> None:
        if bins:
            if not gaps[gap]:
                k = bisect.bisect_left(open_gaps, gap)
                if k == len(open_gaps) or open_gaps[k] != gap:
                    open_gaps.insert(k, gap)
            gaps[gap].append((bins, items))

    for x in sorted((x for x in left if x <= large), reverse=True):
        n = left[x]
        while n:
            k = bisect.bisect_left(open_gaps, x)
            while k < len(open_gaps) and not gaps[open_gaps[k]]:
                open_gaps.pop(k)
            if k == len(open_gaps):
                each = capacity // x
                put(capacity - each * x, n // each, ((x, each),))
                put(capacity - (n % each) * x, 1 if n % each else 0, ((x, n % each),))
                n = 0
                continue
            gap = open_gaps[k]
            bins, items = gaps[gap].pop()
            each = gap // x
            full = min(bins, n // each)
            n -= full * each
            part = n if full < bins else 0
            n -= part
            put(gap - each * x, full, (*items, (x, each)))
            put(gap - part * x, 1 if part else 0, (*items, (x, part)))
            put(gap, bins - full - (1 if part else 0), items)
    runs, used, sequence = [], defaultdict(int), 0
    for gap in sorted(gaps):
        for bins, items in gaps[gap]:
            offset = 0
            for x, each in items:
                runs.append(Run(x, used[x], bins, each, sequence, offset))
                used[x] += bins * each
                offset += x * each
            sequence += bins
    return runs, sequence


class WordIds:
    """Ids of words, as bytes, from the `tokenizers` library; words repeat, so that their ids are remembered, in
    two generations that bound their number. A worker has one for all its tasks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocab, self.lib = bpe.vocabulary(path), Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.is_end = np.zeros(self.lib.get_vocab_size(), bool)
        for i, t in self.vocab.strings.items():
            self.is_end[i] = t.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def know(self, pieces: list[list[str]]) -> dict[str, bytes]:
        """Ids of all these words, and of others."""
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set(itertools.filterfalse(young.__contains__, itertools.chain.from_iterable(pieces)))
        again = [p for p in new if p in old]
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        self._learn(list(new.difference(again)))
        return young

    def _learn(self, new: list[str]) -> None:
        """The library encodes many new words in one call."""
        young, vocab = self.young, self.vocab
        for p in [p for p in new if p[:1] == "\x00" and p[1:] in vocab.special]:
            young[p] = np.array([vocab.special[p[1:]]], "<u4").tobytes()
        plain = [p for p in new if p not in young]
        for lo in range(0, len(plain), 5000):
            part = plain[lo : lo + 5000]
            ids = np.array(self.lib.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                for p, a, b in zip(part, at[:-1], at[1:], strict=True):
                    young[p] = data[a:b]
            else:  # a word that the library would split again when it stands alone
                for p in part:
                    young[p] = np.array(vocab.encode_piece(p), "<u4").tobytes()


@remember_for(__name__)
@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenized(path: str, capacity: int):
    """Pieces of each document."""

    def run(batches):
        known = word_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        names, types = ["id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for b in slices(batches):
            rows = []
            pieces = [known.vocab.pieces(t or "") for t in b.column("text").to_pylist()]
            get = known.know(pieces).__getitem__
            for i, words in zip(b.column("id").to_pylist(), pieces, strict=True):
                data = b"".join([*map(get, words), end])
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            yield batch(names, types, list(zip(*rows, strict=True)))

    return tidied(run)


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32: each document's ids and the end token, cut at the capacity."""
    src = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return src.mapInArrow(_tokenized(path or bpe.vocabulary_path(), capacity), _PIECES)


def _placed(runs: list[Run]):
    table = sorted((r.length, r.first, r.bins, r.each, r.sequence, r.offset) for r in runs)
    length, first, bins, each, sequence, offset = (np.array(c, np.int64) for c in zip(*table, strict=True)) if table else [np.zeros(0, np.int64)] * 6
    starts = {x: k for k, x in reversed(list(enumerate(length.tolist())))}
    counts = np.unique(length, return_counts=True)
    sizes = dict(zip(counts[0].tolist(), counts[1].tolist(), strict=True))

    def run(batches):
        for b in batches:
            x, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.empty(len(x), np.int64)
            for value in np.unique(x).tolist():
                of = x == value
                lo = starts[value]
                k[of] = lo + np.searchsorted(first[lo : lo + sizes[value]], rank[of], side="right") - 1
            within = rank - first[k]
            out = b.drop_columns(["rank"]) if hasattr(b, "drop_columns") else b.select([n for n in b.schema.names if n != "rank"])
            arrays = [*out.columns, pa.array(sequence[k] + within // each[k]), pa.array(offset[k] + within % each[k] * x)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*out.schema.names, "sequence_id", "offset"])

    return tidied(run)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, length, ...) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece is longer than the capacity")
    runs, _ = pack_counts(counts, capacity)
    buckets = max(RANK_BUCKETS, -(-max(counts.values(), default=0) // RANK_ROWS))
    rows = pieces.withColumn("__b", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    by_bucket = rows.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = by_bucket.select(F.col("length").alias("__l"), F.col("__b").alias("__c"), (F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__b").orderBy("id", "piece")) - 1
    rows = rows.withColumn("__r", rank).join(before, (F.col("length") == F.col("__l")) & (F.col("__b") == F.col("__c")))
    rows = rows.select(*pieces.columns, (F.col("__before") + F.col("__r")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(_placed(runs), schema)


def lower_bound(total: int, capacity: int = CAPACITY) -> int:
    return math.ceil(total / capacity)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(cut(token_pieces(df, id_col, text_col, path, capacity)), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
