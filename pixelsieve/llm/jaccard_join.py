r"""N-gram Jaccard join: size-aware, exact.

A document's set holds its distinct word shingles. Two sets of sizes a and b that link differ in at most H
shingles, a bound that follows from the sizes. So sizes are put into classes, the shingles of a class's sets
are dealt by hash to H + t parts, and linked sets agree on at least t whole parts. Each set names its parts;
only sets that share names can link.

Light classes (small sets, where H is small) enumerate subsets: H + 2 parts, and one name for each subset of
two parts. Heavy classes (large sets) name single parts, and the list of sets under each name is scanned. The
boundary follows from cost, for the number of sets of each class: names, list entries that are expected to meet
by chance, and the comparisons of light sets that do, as one name makes them candidates.

As linked sets share t names, a single one in common is no candidate. Names that few sets have give pairs, which
are counted; names that many sets have are counted by set. A pair is a candidate if its count, and the number of
such long lists that both sets are on, can add up to t. Sets that are on t long lists or more are connected by
way of these lists, each list being a point that its sets are connected with. This leaves documents that only share
a passage out of what follows, without a pair of a long list ever being made. A task that finds a name on more than
SHORT of its own sets knows the list to be long: it passes its sets on as they are, and asks for the name once, so
that no name brings all its sets to one task.

Equal sets are one node throughout. Nodes that share names, by way of any chain, form a candidate component;
all pairs in it are compared, by matrix products over the shingles that occur twice. In a component of more than
BLOCK nodes, each is first compared with one of them, the pivot, that is on the most lists. The Jaccard distance is
a metric, so that nodes within half the allowed distance of the pivot all link with each other: this ball needs no
comparison, and its links are counts. What is left is cut into blocks and compared, block by block, with itself and
with the ball, in tasks of their own, so that no task holds a whole large group and no pair becomes a row: a task
returns each node's smallest linked node, and the number of its links. A group of near copies of one text thus costs
in proportion to its texts; a component whose nodes are far from the pivot costs the square of their number. No
cap, no sample: links are lost only where two 64-bit shingle hashes collide.

Defined results: null and empty texts have the empty set and link with nothing; a text of fewer words than a
shingle has one shingle of all its words; rows without an id link with nothing and have a null component;
repeated rows are copies of each other, and rows of one id with different texts are told apart; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, cut, pick, read, tidied, unique_names, utf8_views
from pixelsieve.llm.components import connected_components

#: Nodes of a candidate component that one task compares with each other, or with as many others.
BLOCK = 500
#: Spare parts of heavy classes, as a share of H.
SPARE = 0.3
#: Names that at most so many nodes have give pairs of nodes; longer lists are scanned.
SHORT = 8
#: For the cost of a boundary, in names: the chance that a shingle of one set is in another set of its size, what a
#: pair on a short list costs that meets by chance, and what it costs to compare a shingle of two sets.
CHANCE, FOLLOW, COMPARE = 0.05, 0.3, 0.005

_U = np.uint64
_rng = np.random.default_rng(20170917)
_LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
for _c in range(65, 91):
    _LETTER[_c] = _LETTER[_c + 32]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def _powers(n: int):
    return _powers_to(1 << max(16, (n - 1).bit_length() if n > 1 else 0))


def word_hashes(data) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, A-Z lower-cased."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, _U)
    inside = ~_SPACE[a]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(a))
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum(_LETTER[a] * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingles(data, k: int) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of UTF-8 text."""
    w = word_hashes(data)
    if not len(w):
        return w
    if len(w) < k:
        h = np.full(1, len(w), _U)
        for x in w:
            h = mix(h * _BASE + x)
        return h
    h = np.full(len(w) - k + 1, k, _U)
    for j in range(k):
        h = mix(h * _BASE + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def set_key(u: np.ndarray) -> tuple[int, int]:
    """127 bits that stand for a set; the lowest bit of the first number is free."""
    d = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True) & ~1, int.from_bytes(d[8:], "little", signed=True)


class Classes:
    """Size classes for links with 100 * intersection >= percent * union."""

    def __init__(self, percent: int, light_below: int = 0):
        self.percent, self.light_below = percent, light_below
        self.low, self.high = [], []
        at = 1
        while at < 1 << 40:
            self.low.append(at)
            self.high.append(max(at, at * 10000 // percent**2))
            at = self.high[-1] + 1

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.high, n))

    def reach(self, c: int) -> int:
        """The largest size that links with a set of class c."""
        return 100 * self.high[c] // self.percent

    def bound(self, c: int) -> int:
        """H: in how many shingles linked sets that meet in class c differ at most."""
        return (self.high[c] + self.reach(c)) * (100 - self.percent) // (100 + self.percent)

    def light(self, c: int) -> bool:
        return c < self.light_below

    def spare(self, c: int) -> int:
        return 2 if self.light(c) else max(1, int(SPARE * self.bound(c)))

    def meets_in(self, n: int) -> list[int]:
        """The classes in which a set of n shingles meets others: its own, and the one below if that reaches it."""
        c = self.of(n)
        return [c, c - 1] if c and n <= self.reach(c - 1) else [c]


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The class from which on sets are heavy: the cheapest one, for the number of sets of each class."""
    classes = Classes(percent)

    def cost(c: int, n: int, light: bool) -> float:
        h = classes.bound(c)
        parts = h + (2 if light else max(1, int(SPARE * h)))
        names = parts * (parts - 1) / 2 if light else parts
        held = classes.low[c] / parts * (2 if light else 1)
        meets = CHANCE**held if h else 0.0  # where H is 0 only equal sets have a name in common
        compared = classes.low[c] * n * n * min(1.0, names * meets) if light else 0
        return n * names * (1 + FOLLOW * min(SHORT, n * meets)) + COMPARE * compared

    top = max(sizes, default=0) + 1
    costs = [sum(cost(c, n, c < b) for c, n in sizes.items()) for b in range(top + 1)]
    return int(np.argmin(costs))


def names(u: np.ndarray, c: int, classes: Classes) -> tuple[np.ndarray, int]:
    """The names of a set in class c, and how many of them a set that links shares with another one at least.

    Empty parts have no name, as all sets with one would share it; so many fewer names must be shared. A set
    for which that leaves none to be shared does name its empty parts."""
    spare = classes.spare(c)
    m = classes.bound(c) + spare
    part = ((u >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    content = np.add.reduceat(mix(u + _BASE), starts) if len(u) else np.zeros(0, _U)
    salt = mix(np.array([c * 2 + classes.light(c) + 1], _U))[0]
    if classes.light(c):
        whole = np.zeros(m, _U)
        whole[part[starts]] = content
        whole = mix(whole + np.arange(1, m + 1, dtype=_U) * _BASE)
        i, j = np.triu_indices(m, 1)
        return mix(whole[i] * _BASE + whole[j] + salt), 1
    empty = m - len(starts)
    if spare > empty:
        return mix(mix(content + (part[starts] + 1).astype(_U) * _BASE) + salt), spare - empty
    whole = np.zeros(m, _U)
    whole[part[starts]] = content
    return mix(mix(whole + np.arange(1, m + 1, dtype=_U) * _BASE) + salt), 1


def _need(u: np.ndarray, c: int, classes: Classes) -> int:
    """The number that names() returns, for a heavy class."""
    spare = classes.spare(c)
    m = classes.bound(c) + spare
    part = ((u >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    return max(1, spare - (m - int(np.count_nonzero(np.diff(part, prepend=-1)))))


def _sets(k: int, percent: int):
    heavy = Classes(percent)

    def run(batches):
        cols, types = ["id", "n", "h1", "h2", "own", "below"], [pa.int64()] * 4 + [pa.int32()] * 2
        for b in batches:
            rows = []
            for i, view in zip(b.column("id").to_pylist(), utf8_views(b.column("text")), strict=True):
                u = shingles(view, k)
                meets = heavy.meets_in(len(u)) if len(u) else []
                needs = [_need(u, c, heavy) for c in meets] + [None, None]
                rows.append((i, len(u), *set_key(u), needs[0], needs[1]))
            if rows:
                yield batch(cols, types, list(zip(*rows, strict=True)))

    return tidied(run)


#: A name, and the node that has it; the node's lowest bit says whether it is that of the class below its own. With
#: MARK for a node, the name is known to be on a long list.
_RECORD = np.dtype([("name", "<u8"), ("node", "<i8")])
MARK = -1
_ASKED = "bucket int, long boolean, data binary"


def _packed(a: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records of a task, as one value for each bucket of names; and, as they are, those of names with more than SHORT
    nodes, in parts that are dealt by their first node."""
    a = a[np.argsort(a["name"], kind="stable")]
    starts = np.flatnonzero(np.concatenate(([True], a["name"][1:] != a["name"][:-1])))
    size = np.diff(np.append(starts, len(a)))
    often = np.repeat(size > SHORT, size)
    marks = a[starts[size > SHORT]].copy()
    marks["node"] = MARK
    asked = np.concatenate((a[~often], marks))
    bucket = (asked["name"] % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    asked, bucket = asked[order], bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    data = [asked[x:y].tobytes() for x, y in zip(at, [*at[1:], len(asked)], strict=True)]
    where, known = bucket[at].tolist(), a[often]
    for lo in range(0, len(known), 20000):
        data.append(known[lo : lo + 20000].tobytes())
        where.append(int(known["node"][lo] >> 1) % buckets)
    return batch(["bucket", "long", "data"], [pa.int32(), pa.bool_(), pa.binary()], [where, [False] * len(at) + [True] * (len(data) - len(at)), data])


def _named(k: int, classes: Classes, buckets: int):
    """Each batch's names, packed into one value for each bucket of names."""

    def run(batches):
        for b in batches:
            out, seen, held = [], set(), 0
            for view in utf8_views(b.column("text")):
                u = shingles(view, k)
                if not len(u):
                    continue
                node = set_key(u)[0]
                if node in seen:
                    continue
                seen.add(node)
                for below, c in enumerate(classes.meets_in(len(u))):
                    found, _ = names(u, c, classes)
                    r = np.empty(len(found), _RECORD)
                    r["name"], r["node"] = found, node | below
                    out.append(r)
                    held += len(r)
                if held > 400_000:
                    yield _packed(np.concatenate(out), buckets)
                    out.clear()
                    held = 0
            if out:
                yield _packed(np.concatenate(out), buckets)

    return tidied(run)


_FOUND = "long boolean, a long, b long, n int"


@tidied
def _shared(batches):
    """Of one bucket's names that two nodes or more have: pairs of nodes with their number of names in common,
    for names with few nodes; name and node, for others."""

    def rows(long: bool, a, b, n) -> pa.RecordBatch:
        return batch(["long", "a", "b", "n"], [pa.bool_(), pa.int64(), pa.int64(), pa.int32()], [np.full(len(a), long), a, b, n])

    def on_list(name, node) -> pa.RecordBatch:
        return rows(True, np.ascontiguousarray(name).view(np.int64), np.ascontiguousarray(node), np.ones(len(name), np.int32))

    def found(parts: list[bytes]):
        a = np.frombuffer(b"".join(parts), _RECORD)
        order = np.lexsort((a["node"], a["name"]))
        name, node = a["name"][order], a["node"][order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (node[1:] >> 1 != node[:-1] >> 1)
        name, node = name[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(starts, len(name)))
        known = np.add.reduceat(node == MARK, starts) > 0
        many = np.repeat(known | (size > SHORT), size) & (node != MARK)
        if many.any():
            yield on_list(name[many], node[many])
        pairs = [np.empty((2, 0), np.int64)]
        for g in range(2, SHORT + 1):
            at = starts[(size == g) & ~known]
            pairs += [np.stack((node[at + i], node[at + j])) for i in range(g) for j in range(i + 1, g)]
        left, right = np.concatenate(pairs, axis=1)
        if len(left):
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            at = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
            yield rows(False, left[at], right[at], np.diff(np.append(at, len(left))).astype(np.int32))

    now, parts = None, []
    for b in batches:
        for bucket, long, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "long", "data")), strict=True):
            if long:
                a = np.frombuffer(data, _RECORD)
                yield on_list(a["name"], a["node"])
                continue
            if bucket != now and parts:
                yield from found(parts)
                parts = []
            now = bucket
            parts.append(data)
    if parts:
        yield from found(parts)


def linked(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Which of the sets link (never with themselves); with split, only those before it with those from it on."""
    g = len(sets)
    sizes = np.array([len(u) for u in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(g), sizes)
    order = np.argsort(everything, kind="stable")
    value, owner = everything[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    count = np.diff(np.append(starts, len(value)))
    keep = np.repeat(count > 1, count)
    column = np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    owner = owner[keep]
    common = np.zeros((g, g), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    width = max(256, (1 << 21) // g)
    for lo in range(0, total, width):
        x, y = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((g, min(width, total - lo)), np.float32)
        m[owner[x:y], column[x:y] - lo] = 1
        if split is None:
            common += m @ m.T
        else:
            common[:split, split:] += m[:split] @ m[split:].T
    if split is not None:
        common = common + common.T
    out = np.empty((g, g), bool)
    for lo in range(0, g, 128):  # whole numbers take more room than the matrix
        both = common[lo : lo + 128].astype(np.int64)
        out[lo : lo + 128] = 100 * both >= percent * (sizes[lo : lo + 128, None] + sizes[None, :] - both)
    if split is not None:
        out[:split, :split] = False
        out[split:, split:] = False
    np.fill_diagonal(out, False)
    return out


def _within_half(k: int, percent: int):
    """Of each unit, one row of which is a component's pivot: which nodes are within half the allowed distance."""

    def run(batches):
        now, pivot, done = None, None, set()
        for b in batches:
            out = []
            for view, unit, comp, h1, h2, first in zip(utf8_views(b.column("text")), *(b.column(c).to_pylist() for c in ("unit", "comp", "h1", "h2", "first")), strict=True):
                if unit != now:
                    now, pivot, done = unit, None, set()
                if (first and pivot is not None) or (not first and pivot is None) or (h1, h2) in done:
                    continue
                u = shingles(view, k)
                if set_key(u) != (h1, h2):  # another row with this id may have another text
                    continue
                if first:
                    pivot = u
                    continue
                done.add((h1, h2))
                both = len(np.intersect1d(pivot, u, assume_unique=True))
                either = len(pivot) + len(u) - both
                if 200 * (either - both) <= (100 - percent) * either:
                    out.append((h1, comp))
            if out:
                yield batch(["node", "comp"], [pa.int64()] * 2, list(zip(*out, strict=True)))

    return tidied(run)


def _compared(k: int, percent: int):
    """Links of one unit: all pairs of its nodes, or of one block's nodes with another's."""

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[3])  # by side
        sets = [r[0] for r in rows]
        sides = [r[3] for r in rows]
        split = sides.index(1) if sides[0] == 0 and sides[-1] == 1 else None
        if split is None and rows[0][4]:
            return None  # one block of a pair is empty
        links = linked(sets, percent, split)
        node, copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        n = np.array([copies[row].sum() for row in links])
        some = np.flatnonzero(n)
        if not len(some):
            return None
        links, root = links[np.ix_(some, some)], node[some].copy()
        while True:
            least = [np.where(links[lo : lo + 128], root[None, :], np.iinfo(np.int64).max).min(axis=1) for lo in range(0, len(root), 128)]
            new = np.minimum(root, np.concatenate(least))
            if np.array_equal(new, root):
                break
            root = new
        return batch(["node", "root", "links"], [pa.int64()] * 3, [node[some], root, n[some]])

    def run(batches):
        now, rows, seen = None, [], set()
        for b in batches:
            cols = ("unit", "copies", "h1", "h2", "side", "pair")
            for view, unit, copies, h1, h2, side, pair in zip(utf8_views(b.column("text")), *(b.column(c).to_pylist() for c in cols), strict=True):
                if unit != now:
                    if rows and (out := found(rows)) is not None:
                        yield out
                    now, rows, seen = unit, [], set()
                if (h1, h2) in seen:
                    continue
                u = shingles(view, k)
                if set_key(u) == (h1, h2):  # another row with this id may have another text
                    seen.add((h1, h2))
                    rows.append((u, h1, copies, side, pair))
        if rows and (out := found(rows)) is not None:
            yield out

    return tidied(run)


def _balls(held: DataFrame, on_lists: DataFrame, k: int, percent: int, block: int, tasks: int) -> DataFrame:
    """node, comp: the nodes of large components (text, h1, h2, comp, size) that are within half the allowed distance
    of their component's pivot. A component's nodes are dealt to units, and its pivot goes to each."""
    lists = on_lists.groupBy(F.col("node").bitwiseAND(F.lit(-2)).alias("node")).agg(F.sum("lists").alias("lists"))
    ranked = held.select("h1", "h2", "comp", "size").join(lists, F.col("h1") == F.col("node"), "left")
    pivots = ranked.groupBy("comp", "size").agg(F.max(F.struct(F.coalesce("lists", F.lit(0)).alias("lists"), "h1", "h2")).alias("p"))
    units = F.ceil(F.col("size") / block).cast("int")
    pivots = pivots.select(F.col("p.h1").alias("p1"), F.explode(F.sequence(F.lit(0), units - 1)).alias("at"))
    rows = held.select("text", "h1", "h2", "comp", F.pmod(F.xxhash64("h1"), units).cast("int").alias("at"), F.lit(False).alias("first"))
    rows = rows.unionByName(held.join(pivots, F.col("h1") == F.col("p1")).select("text", "h1", "h2", "comp", "at", F.lit(True).alias("first")))
    dealt = rows.select("text", "h1", "h2", "comp", "first", F.xxhash64("comp", "at").alias("unit")).repartition(tasks, "unit")
    return cut(dealt.sortWithinPartitions("unit", F.desc("first")).mapInArrow(_within_half(k, percent), "node long, comp long"))


def jaccard_components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links) and n_links; a row for each input row."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    members = cut(docs.mapInArrow(_sets(k, percent), "id long, n long, h1 long, h2 long, own int, below int"))
    classes_of = members.filter("id is not null and n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("n", "own", "below")])

    # Names, and the nodes that share enough of them.
    high = Classes(percent).high
    edges = ", ".join(f"{x}L" for x in high[:-1])
    per_class = classes_of.select(F.expr(f"size(filter(array({edges}), x -> x < n))").alias("c")).groupBy("c").agg(F.count("*").alias("sets"))
    sizes = {r["c"]: r["sets"] for r in per_class.collect()}  # a row for each class: a few dozen
    heavy_from = boundary(sizes, percent)
    classes = Classes(percent, heavy_from)
    named = docs.filter("id is not null").mapInArrow(_named(k, classes, 4 * tasks), _ASKED)
    shared = cut(named.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _FOUND))
    light_own, light_below = (F.col("n") <= (high[heavy_from - 1] if heavy_from else 0)), (F.col("n") <= (high[heavy_from] if heavy_from else 0))
    needs = F.array(
        F.struct(F.col("h1").alias("node"), F.when(light_own, 1).otherwise(F.col("own")).alias("need")),
        F.struct(F.col("h1").bitwiseOR(F.lit(1)).alias("node"), F.when(light_below, 1).otherwise(F.col("below")).alias("need")),
    )
    needed = classes_of.select(F.explode(needs).alias("x")).select("x.*").filter("need is not null").groupBy("node").agg(F.min("need").alias("need"))
    # A set that several tasks have met is on a long list once.
    listed = cut(shared.filter("long").select(F.col("a").alias("name"), F.col("b").alias("node")).distinct())
    on_lists = listed.groupBy("node").agg(F.count("*").alias("lists"))
    nodes = needed.join(on_lists, "node", "left").select("node", "need", F.coalesce("lists", F.lit(0)).alias("lists"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("need").alias(f"need_{x}"), F.col("lists").alias(f"lists_{x}"))
    pairs = shared.filter("not long").groupBy("a", "b").agg(F.sum("n").alias("n")).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.filter("n >= greatest(1, greatest(need_a, need_b) - least(lists_a, lists_b))")
    whole = lambda c: F.col(c).bitwiseAND(F.lit(-2))
    pairs = pairs.select(whole("a").alias("a"), whole("b").alias("b"))
    # A list is a point too, by an odd number. A node has an edge to the first of its lists, and edges from there to
    # the others, which many nodes have in common, connect the same as one to each.
    live = listed.join(nodes.filter("lists >= need").select("node"), "node").select(F.col("name").bitwiseOR(F.lit(1)).alias("name"), whole("node").alias("node"))
    stars = live.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("all"))
    stars = stars.select(F.element_at("all", 1).alias("a"), F.explode(F.concat(F.expr("slice(all, 2, size(all))"), F.array("node"))).alias("b"))
    candidates = connected_components(stars.unionByName(pairs))  # node, root

    # Compare all nodes of a candidate component that no ball settles, in blocks where it is large.
    inside = cut(classes_of.join(candidates, F.col("h1") == F.col("node")).select("h1", "h2", "rep", "copies", F.col("root").alias("comp")))
    sized = inside.groupBy("comp").agg(F.count("*").alias("size")).filter("size > 1")
    inside = cut(inside.join(sized, "comp").select("h1", "h2", "rep", "copies", "comp", "size"))
    held = cut(docs.join(inside, F.col("id") == F.col("rep")).select("text", "copies", "h1", "h2", "comp", "size"))
    balls = _balls(held.filter(F.col("size") > block), on_lists, k, percent, block, tasks)
    inside = inside.join(balls.select("node"), F.col("h1") == F.col("node"), "left").select("h1", "copies", "comp", "size", F.col("node").isNotNull().alias("ball"))
    inside = cut(inside.distinct())
    ball = inside.filter("ball").groupBy("comp").agg(F.count("*").alias("held"), F.sum("copies").alias("all_copies"), F.min("h1").alias("least"))
    in_ball = inside.filter("ball").join(ball, "comp").select(F.col("h1").alias("node"), F.col("least").alias("root"), (F.col("all_copies") - F.col("copies")).alias("links"))
    rest, more = F.ceil((F.col("size") - F.coalesce("held", F.lit(0))) / block).cast("int"), F.ceil(F.coalesce("held", F.lit(0)) / block).cast("int")
    left = inside.join(ball.select("comp", "held"), "comp", "left").select(F.col("h1").alias("node"), "ball", rest.alias("rest"), more.alias("more")).filter("rest > 0")
    spot = F.xxhash64("node")
    left = left.withColumn("mine", F.when(F.col("ball"), F.col("rest") + F.pmod(spot, F.greatest("more", F.lit(1)))).otherwise(F.pmod(spot, F.col("rest"))).cast("int"))
    units = F.expr("transform(sequence(0, if(ball, rest, rest + more) - 1), x -> struct(least(x, mine) as lo, greatest(x, mine) as hi, if(x = mine, -1, if(mine < x, 0, 1)) as side))")
    texts = held.join(left, F.col("h1") == F.col("node")).select("text", "copies", "h1", "h2", "comp", F.explode(units).alias("u"))
    texts = texts.select("text", "copies", "h1", "h2", F.xxhash64("comp", "u.lo", "u.hi").alias("unit"), F.col("u.side").alias("side"), (F.col("u.lo") != F.col("u.hi")).alias("pair"))
    compared = texts.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(_compared(k, percent), "node long, root long, links long")
    compared = cut(compared.unionByName(in_ball))
    roots = connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))

    found = classes_of.select("h1", "h2", "rep", "copies").join(roots.join(links, "node"), F.col("h1") == F.col("node"), "left").drop("node")
    found = cut(found)
    least = found.filter("root is not null").groupBy("root").agg(F.min("rep").alias("first")).withColumnRenamed("root", "of")
    found = found.join(least, F.col("root") == F.col("of"), "left")
    found = found.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("first", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("linked"))
    lonely = F.col("n") == 0
    on = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & ~lonely & F.col("id").isNotNull()
    return members.join(found, on, "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(lonely, F.col("id")).when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, but of each component only those with its smallest id."""
    df, restore = unique_names(df)
    gone = jaccard_components(df, k, percent, id_col, text_col).filter("component_id <> id").select(F.col("id").alias("__gone")).distinct()
    return restore(df.join(gone, df[id_col].cast("long") == gone["__gone"], "left_anti"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
c(a, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON c.a = e.a),
m AS (SELECT a, min(root) AS root FROM c GROUP BY a),
l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, coalesce(l.links, 0) AS n_links
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.a = d.doc_id
"""
