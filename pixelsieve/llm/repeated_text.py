"""Removal of repeated text by distributed prefix doubling.

Every byte that is covered by a string of `length` bytes which also starts anywhere else goes; strings are
judged on the input, overlaps and the same document count, and matches never cross documents.

Plain prefix doubling sorts the ranks of all text positions again at each offset, which for a corpus moves many
times its size. Here positions are sampled first, in a way that equal strings agree on: each window of `length`
bytes names as its anchor the last of those of its K-byte strings that have the smallest hash. Equal windows
have equal anchors at equal distances, so that windows can be told apart anchor by anchor. A round has, for each
anchor that is still open, a range of its windows, and two names for it: the name of the text that all windows
of the range share (it grows from round to round, from K bytes to a whole window), and the name of all text
that they cover. Spark brings equal names together, as in reranking:

- where the shared text occurs once, no window of the range repeats: the anchor is done;
- where all covered text occurs again, every window of the range repeats: it is done, past the threshold; one
  of each such group goes on as a witness while ranges that share its text are open;
- what is left is cut into ranges of the next width and named again, until a range is one window, whose
  shared and covered text are one.

Names are 64-bit hashes. Names that occur often are met early: a task first counts its own, answers what it
already knows, and asks once for the rest, so that a passage of a third of all documents makes no hot spot.
Texts move once, compressed and in packs, and lie in the shared checkpoint folder by pack from then on.

Defined results: null counts as empty; texts shorter than `length` stay whole; repeated rows repeat each other;
a row without an id counts like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, ensure_checkpoint_dir, pick, read, table_folder, tidied, utf8_views
from pixelsieve.llm.jaccard_join import _powers, mix

LENGTH = 400
K = 32
#: Widths of a range of windows, by round; each divides the one before it.
WIDTHS = (48, 6, 1)
PACK_ROWS, PACK_BYTES = 64, 1 << 18
#: Windows of a very long text that are looked at together.
STRIDE = 1 << 22
#: A name that a task has so often itself is known to repeat; the task doesn't ask for it.
OFTEN = 64

_U = np.uint64
_rng = np.random.default_rng(60221023)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOW = _U(0xFFFFFF)
_SALT = _U(0xD6E8FEB86659FD93)

_ASK = np.dtype([("core", "<u8"), ("span", "<u8"), ("pack", "<i8"), ("doc", "<i4"), ("p", "<i4"), ("near", "<i4"), ("far", "<i4"), ("kind", "<i4")])
_ANSWER = "pack long, doc int, p int, near int, far int, kind int"
#: Kinds of questions: one to be answered; a range that is known to repeat, for others; a mark that others with
#: this shared text are open. Kinds of answers: all windows repeat; open; open for others only.
ASK, KNOWN, MARK = 0, 1, 2
REPEATS, OPEN, WITNESS = 1, 2, 3


class Text:
    """Hashes of any substring of a text."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_BYTE[data] * up[: self.n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


def anchors(t: Text, length: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """The anchors of windows first to last - 1: place, distance to the last and to the first window start that
    names it, and the hash of its K bytes."""
    width = length - K + 1
    m = last - first + width - 1
    at = np.arange(first, first + m)
    h = t.hash(at, at + K)
    # smallest hash first, of equal ones the last
    value = (h & ~_LOW) | (_LOW - np.arange(m, dtype=_U))
    rows = -(-m // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, _U)
    grid[:m] = value
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: last - first], ahead[width - 1 : width - 1 + last - first])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    start = np.flatnonzero(np.diff(place, prepend=-1))
    end = np.append(start[1:], last - first) - 1
    p = place[start]
    return p + first, p - end, p - start, h[p]


def _named(t: Text, p, near, far, cell_near, cell_far, length, level: int):
    """Names of the text that all windows of the cell share, and of the text that the anchor's own windows in
    it cover. near and far are distances from a window's start to its anchor."""
    salt = ((cell_near * 1024 + cell_far) * 8 + level).astype(_U) * _SALT
    core = mix(t.hash(p - cell_near, p - cell_far + length) + salt)
    own = (near * 1024 + far).astype(_U) * _SALT
    span = mix(t.hash(p - far, p - near + length) + mix(core + own))
    return core, span


def _first_names(t: Text, length: int):
    for first in range(0, t.n - length + 1, STRIDE):
        p, near, far, h = anchors(t, length, first, min(first + STRIDE, t.n - length + 1))
        own = (near * 1024 + far).astype(_U) * _SALT
        yield p, near, far, h, mix(t.hash(p - far, p - near + length) + mix(h + own))


def _next_names(t: Text, p, near, far, length: int, level: int):
    """The open ranges, cut into cells of this round's width."""
    width = WIDTHS[level - 1]
    lo, hi = near // width, far // width
    count = hi - lo + 1
    p, near, far = (np.repeat(x, count) for x in (p, near, far))
    cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    cell_near, cell_far = cell * width, np.minimum(cell * width + width - 1, length - K)
    near, far = np.maximum(near, cell_near), np.minimum(far, cell_far)
    return p, near, far, *_named(t, p, near, far, cell_near, cell_far, length, level)


# Packs: many texts in one row


@tidied
def _pack(batches):
    task = TaskContext.get()
    base, count = (task.partitionId() if task else 0) << 32, 0
    squeeze = zstandard.ZstdCompressor(level=1)
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    for b in batches:
        rows, ids, lens, parts = [], [], [], []
        for i, view in zip(b.column("id").to_pylist(), utf8_views(b.column("text")), strict=True):
            ids.append(i)
            lens.append(len(view))
            parts.append(bytes(view))
            if len(ids) == PACK_ROWS or sum(lens) >= PACK_BYTES:
                rows.append((base + count, ids, lens, squeeze.compress(b"".join(parts))))
                count += 1
                ids, lens, parts = [], [], []
        if ids:
            rows.append((base + count, ids, lens, squeeze.compress(b"".join(parts))))
            count += 1
        if rows:
            yield batch(["pack", "ids", "lens", "data"], types, list(zip(*rows, strict=True)))


def _unpacked(b: pa.RecordBatch):
    """(pack, ids, lens, bytes) of each row."""
    loose = zstandard.ZstdDecompressor()
    for pack, ids, lens, data in zip(*(b.column(c) for c in ("pack", "ids", "lens", "data")), strict=True):
        yield pack.as_py(), ids.as_py(), lens.as_py(), loose.decompress(data.as_py())


# Asking for names


class _Questions:
    """What a task asks and already knows, as rows: by bucket of names, or for the answers as they are."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, pack, doc, p, near, far, core, span, kind=ASK) -> None:
        a = np.empty(len(p), _ASK)
        a["core"], a["span"], a["pack"], a["doc"], a["p"], a["near"], a["far"], a["kind"] = core, span, pack, doc, p, near, far, kind
        self.parts.append(a)
        self.size += len(a)

    def rows(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        a = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        ask = a["kind"] == ASK
        weight = np.where(ask, 1, 2)
        _, of_core = np.unique(a["core"], return_inverse=True)
        _, span_at, of_span = np.unique(a["span"], return_index=True, return_inverse=True)
        spans = np.bincount(of_span, weight)
        repeats = spans[of_span] > 1
        often = ask & ~repeats & (np.bincount(of_core)[of_core] > OFTEN)
        # One row stands for all with a name that the task knows to repeat, and one for the open ones.
        known = a[span_at[spans > 1]].copy()
        known["kind"] = KNOWN
        mark = a[often]
        mark = mark[np.unique(mark["core"], return_index=True)[1]]
        mark["kind"] = MARK
        asked = np.concatenate((a[ask & ~repeats & ~often], known, mark))
        bucket = (asked["core"] % _U(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        asked, bucket = asked[order], bucket[order]
        at = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        data = [asked[x:y].tobytes() for x, y in zip(at, [*at[1:], len(asked)], strict=True)]
        where, kind = bucket[at].tolist(), [0] * len(at)
        for k, rest in ((REPEATS, a[ask & repeats]), (OPEN, a[often])):
            for lo in range(0, len(rest), 20000):
                data.append(rest[lo : lo + 20000].tobytes())
                where.append(int(rest["pack"][lo] % self.buckets))
                kind.append(k)
        return batch(["bucket", "kind", "data"], [pa.int32(), pa.int32(), pa.binary()], [where, kind, data])


def _ask_first(length: int, buckets: int):
    def run(batches):
        q = _Questions(buckets)
        for b in batches:
            for pack, _, lens, data in _unpacked(b):
                whole, at = np.frombuffer(data, np.uint8), 0
                for doc, n in enumerate(lens):
                    if n >= length:
                        for found in _first_names(Text(whole[at : at + n]), length):
                            q.add(pack, doc, *found)
                    at += n
                if q.size > 500_000:
                    yield q.rows()
        if (out := q.rows()) is not None:
            yield out

    return tidied(run)


def _listed(b: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
    """The answers that a row's list holds."""
    found = b.column("found")
    if not found[row].is_valid:
        return {}
    values = found[row].values
    return {c: values.field(c).to_numpy(zero_copy_only=False) for c in ("doc", "p", "near", "far", "kind")}


def _by_doc(x: dict[str, np.ndarray]):
    if x:
        order = np.argsort(x["doc"], kind="stable")
        docs, at = np.unique(x["doc"][order], return_index=True)
        for doc, part in zip(docs.tolist(), np.split(order, at[1:]), strict=True):
            yield doc, {c: x[c][part].astype(np.int64) for c in ("p", "near", "far", "kind")}


def _ask_next(length: int, buckets: int, level: int):
    def run(batches):
        q = _Questions(buckets)
        for b in batches:
            for row, (pack, _, lens, data) in enumerate(_unpacked(b)):
                whole, at = np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(lens)))
                for doc, x in _by_doc(_listed(b, row)):
                    t = Text(whole[at[doc] : at[doc + 1]])
                    for of, kind in ((OPEN, ASK), (WITNESS, KNOWN)):
                        some = x["kind"] == of
                        if some.any():
                            q.add(pack, doc, *_next_names(t, x["p"][some], x["near"][some], x["far"][some], length, level), kind)
                if q.size > 500_000:
                    yield q.rows()
        if (out := q.rows()) is not None:
            yield out

    return tidied(run)


@tidied
def _answered(batches):
    """Of a bucket's questions those whose shared text repeats, by whether all their text does; and a witness of
    each range that repeats, where others with its shared text are open."""

    def out(a: np.ndarray, kind) -> pa.RecordBatch:
        names = ["pack", "doc", "p", "near", "far"]
        types = [pa.int64(), *[pa.int32()] * 5]
        return batch([*names, "kind"], types, [*(np.ascontiguousarray(a[c]) for c in names), kind])

    def met(parts: list[bytes]) -> pa.RecordBatch | None:
        a = np.frombuffer(b"".join(parts), _ASK)
        ask = a["kind"] == ASK
        weight = np.where(ask, 1, 2)
        _, of_core = np.unique(a["core"], return_inverse=True)
        _, of_span = np.unique(a["span"], return_inverse=True)
        cores = np.bincount(of_core, weight)[of_core]
        spans = np.bincount(of_span, np.where(a["kind"] == MARK, 0, weight))[of_span]
        is_open = (a["kind"] == MARK) | (ask & (cores > 1) & (spans == 1))
        if not (cores > 1).any():
            return None
        wanted = np.bincount(of_core, is_open)[of_core] > 0
        candidates = np.flatnonzero(wanted & (a["kind"] != MARK) & (spans > 1))
        witness = candidates[np.unique(of_span[candidates], return_index=True)[1]]
        mine = np.flatnonzero(ask & (cores > 1))
        kinds = np.concatenate((np.where(spans[mine] > 1, REPEATS, OPEN), np.full(len(witness), WITNESS)))
        return out(a[np.concatenate((mine, witness))], kinds)

    now, parts = None, []
    for b in batches:
        for bucket, kind, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if kind:
                a = np.frombuffer(data, _ASK)
                yield out(a, np.full(len(a), kind))
                continue
            if bucket != now and parts:
                if (got := met(parts)) is not None:
                    yield got
                parts = []
            now = bucket
            parts.append(data)
    if parts and (got := met(parts)) is not None:
        yield got


def covered(x: dict[str, np.ndarray], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that repeated windows cover."""
    if not x or not len(x["p"]):
        return []
    start, end = x["p"] - x["far"], x["p"] - x["near"] + length
    order = np.argsort(start, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(start[order].tolist(), end[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _removed(length: int):
    def run(batches):
        names = ["id", "n_bytes", "kept", "spans"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for b in batches:
            for row, (_, ids, lens, data) in enumerate(_unpacked(b)):
                found = {doc: covered(x, length) for doc, x in _by_doc(_listed(b, row))}
                rows, at = [], 0
                for doc, (i, n) in enumerate(zip(ids, lens, strict=True)):
                    text, last, kept = data[at : at + n], 0, []
                    for s, e in found.get(doc, ()):
                        kept.append(text[last:s])
                        last = e
                    kept.append(text[last:])
                    rows.append((i, n, b"".join(kept), [{"start": s, "end": e} for s, e in found.get(doc, ())]))
                    at += n
                yield batch(names, types, list(zip(*rows, strict=True)))

    return tidied(run)


def _digested(length: int):
    inner = _removed(length)

    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in inner(batches):
            kept = b.column("kept").to_pylist()
            n = b.column("n_bytes").to_pylist()
            spans = [len(s) for s in b.column("spans").to_pylist()]
            yield batch(names, types, [b.column("id"), n, [x - len(k) for x, k in zip(n, kept, strict=True)], spans, [hashlib.sha256(k).hexdigest() for k in kept]])

    return tidied(run)


def _stored(df: DataFrame) -> DataFrame:
    """df as written to, and read from, the shared checkpoint folder."""
    spark = df.sparkSession
    path = table_folder(spark, "repeated")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _laid_out(packs: DataFrame, tasks: int) -> DataFrame:
    """packs by hash of pack, written to the checkpoint folder; joins on pack find them in place.

    Only a plan that isn't adaptive tells what its partitioning is."""
    spark = packs.sparkSession
    ensure_checkpoint_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return packs.repartition(tasks, "pack").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _repeats(df: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """Packs with the list of their repeated ranges, as `found`."""
    if not K <= length < 1024:
        raise ValueError(f"length must be from {K} to 1023")
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = pick(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    packs = _laid_out(docs.mapInArrow(_pack, "pack long, ids array<long>, lens array<int>, data binary"), tasks)

    def answers(questions: DataFrame) -> DataFrame:
        dealt = questions.repartition(tasks, "bucket").sortWithinPartitions("bucket")
        return _stored(dealt.mapInArrow(_answered, _ANSWER))

    def with_found(rows: DataFrame, how: str) -> DataFrame:
        lists = rows.groupBy("pack").agg(F.collect_list(F.struct("doc", "p", "near", "far", "kind")).alias("found"))
        return packs.join(lists, "pack", how).select("pack", "ids", "lens", "data", "found")

    asked = "bucket int, kind int, data binary"
    buckets = 4 * tasks
    rounds = [answers(packs.mapInArrow(_ask_first(length, buckets), asked))]
    for level in range(1, len(WIDTHS) + 1):
        questions = with_found(rounds[-1].filter(f"kind <> {REPEATS}"), "inner").mapInArrow(_ask_next(length, buckets, level), asked)
        rounds.append(answers(questions))
    repeats = rounds[0].filter(f"kind = {REPEATS}")
    for r in rounds[1:]:
        repeats = repeats.unionByName(r.filter(f"kind = {REPEATS}"))
    return with_found(repeats, "left")


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, kept (the bytes that stay), spans (start and end of the removed runs); a row for each input row."""
    return _repeats(df, length, id_col, text_col).mapInArrow(_removed(length), "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def op3_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _repeats(read(spark, sf_dir, "documents"), LENGTH, "doc_id", "text")
    return found.mapInArrow(_digested(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
