r"""Secret scans, with DataFrame functions alone.

Patterns find the base kinds (``assign``, ``access``, ``hex``); the method adds ``entropy`` spans: a window of
WINDOW characters slides over each candidate string (a maximal run of ``[A-Za-z0-9+/_=-]`` of at least WINDOW
characters that has a digit and a letter), its character counts are updated by the character that enters and
the one that leaves, and the candidate is reported where the Shannon entropy of some window reaches the
threshold of the candidate's character class. A candidate takes time in proportion to its length. Added spans are suppressed where the candidate matches the allow
list (placeholders, UUIDs) or where a base span overlaps it; base spans always stay. ``redact`` also masks the
parts of an overlapped candidate that no base span covers, where such a part alone reaches its threshold.

Positions come from marks: a pattern is replaced by itself between private-use characters (such characters of
the text are first replaced, one for one, by another that no pattern matches), the marked text is split at the
marks, and lengths are summed up. Likewise, whether a base span overlaps a candidate shows in the candidate of a
text whose base spans are covered by another such character, so that no span is held against all others.

Defined results: null or empty text has no spans (base_sha256 of the empty string); positions are code points,
ends exclusive; repeated rows give repeated results; an empty table gives no rows; input columns other than the
id and text are not read by ``scan`` and kept, if their names don't clash, by ``redact``.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.functions.raster import let
from pixelsieve.llm.common import pick, read, unique_names

ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits a character that some window must reach, by class. The most that WINDOW characters can have is log2(20) = 4.32.
THRESHOLDS = {"hex": 3.2, "alnum": 3.6, "base64": 3.8}
#: Candidates of a text with covered spans.
COVERED = rf"[A-Za-z0-9+/_=\ue003-]{{{WINDOW},}}"
ALLOW = r"(?i)example|placeholder|changeme|xxxx|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9]+$"

_OPEN, _CLOSE, _GROUP, _COVER = "\ue000", "\ue001", "\ue002", "\ue003"
_OTHER = "\ufffd"
#: Pieces of a text that are gone through together: an even number.
BLOCK = 1000
LETTERS_A_WORD = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _marked(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def _pieces(marked: Column) -> Column:
    """What lies between marks: outside, inside, outside, ..."""
    return F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)


def _value(piece: Column) -> Column:
    return F.substring_index(piece, _GROUP, -1)


def _spans(marked: Column, kind: int, grouped: bool) -> Column:
    """Spans (start, end, kind, text, value) from a marked text.

    Pieces are gone through in blocks of an even number, so that a list of spans is never long when one is added."""
    strip = (lambda x: F.translate(x, _GROUP, "")) if grouped else (lambda x: x)
    many = "array<struct<start:int,end:int,kind:int,text:string,value:string>>"
    empty, none = F.expr(f"cast(array() as {many})"), F.expr(f"cast(array() as array<{many}>)")

    def step(acc: Column, piece: Column) -> Column:
        plain = strip(piece)
        end = acc["at"] + F.char_length(plain)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), plain.alias("text"), _value(piece).alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def block(acc: Column, pieces: Column) -> Column:
        found = F.aggregate(pieces, F.struct(acc["at"].alias("at"), F.lit(False).alias("inside"), empty.alias("spans")), step)
        return let(found, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["blocks"], F.array(x["spans"])).alias("blocks")))

    def blocks(pieces: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda k: F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("blocks")), block, lambda acc: acc["blocks"]))

    return F.when(F.instr(marked, _OPEN) > 0, let(_pieces(marked), blocks)).otherwise(empty)


def _covered(marked: Column, grouped: bool) -> Column:
    """A marked text without its marks, with the candidate characters inside its spans covered."""

    def piece(x: Column, k: Column) -> Column:
        plain = F.translate(x, _GROUP, "") if grouped else x
        inside = (k % 2 == 1) & (F.char_length(_value(x)) >= ASSIGN_MIN if grouped else F.lit(True))
        return F.when(inside, F.translate(plain, ALPHABET, _COVER * len(ALPHABET))).otherwise(plain)

    return F.array_join(F.transform(_pieces(marked), piece), "")


def best_entropy(s: Column) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of WINDOW characters of s.

    The window's counts are carried along, five bits each, in LETTERS_A_WORD to a 64-bit number: each step raises
    one and lowers one, and changes the sum of c * log2(c), a whole number of units of 2**-40, by those two terms
    alone; the entropy is log2(WINDOW) - sum / WINDOW."""
    term = [round(c * math.log2(c) * 2**40) if c else 0 for c in range(WINDOW + 2)]
    rise = F.array(*[F.lit(b - a).cast("long") for a, b in itertools.pairwise(term)])  # from c to c + 1
    words = -(-len(ALPHABET) // LETTERS_A_WORD)
    letter = F.struct(F.lit(0).alias("word"), F.lit(0).alias("shift"))
    where = lambda c: let(F.ascii(c) - 1, lambda z: F.struct((F.floor(z / LETTERS_A_WORD).cast("int") + 1).alias("word"), (z % LETTERS_A_WORD * 5).alias("shift")))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])
    held = lambda counts, x: F.call_function("shiftright", F.element_at(counts, F.greatest(x["word"], F.lit(1))), x["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        lowered = F.transform(acc["counts"], lambda c, k: F.when(k + 1 == old["word"], c - one(old)).otherwise(c))
        raised = lambda counts: F.transform(counts, lambda c, k: F.when(k + 1 == new["word"], c + one(new)).otherwise(c))

        def after(counts: Column) -> Column:
            less = F.when(old["word"] > 0, F.element_at(rise, held(counts, old) + 1)).otherwise(F.lit(0).cast("long"))
            total = acc["total"] + F.element_at(rise, held(counts, new) + 1) - less
            return F.struct(raised(counts).alias("counts"), total.alias("total"))

        def result(now: Column) -> Column:
            least = F.when(acc["n"] + 1 >= WINDOW, F.least(acc["least"], now["total"])).otherwise(acc["least"])
            return F.struct((acc["n"] + 1).alias("n"), now["counts"].alias("counts"), now["total"].alias("total"), least.alias("least"))

        return let(let(lowered, after), result)

    def whole(letters: Column) -> Column:
        old = F.concat(F.array_repeat(letter, WINDOW), F.slice(letters, F.lit(1), F.size(letters) - WINDOW))
        zero = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(2**62).cast("long").alias("least"))
        return F.aggregate(F.zip_with(letters, old, lambda a, b: F.struct(a.alias("new"), b.alias("old"))), zero, step, lambda acc: acc["least"])

    codes = F.split(F.translate(s, ALPHABET, "".join(chr(k + 1) for k in range(len(ALPHABET)))), "", -1)
    least = let(F.transform(codes, where), whole)
    return F.lit(math.log2(WINDOW)) - least / float(2**40) / WINDOW


def threshold(s: Column) -> Column:
    t = F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"])
    return t.when(s.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])


def _suspicious(s: Column) -> Column:
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~s.rlike(ALLOW) & (best_entropy(s) >= threshold(s))


def _uncovered(x: Column, covers: list[Column]) -> Column:
    """The parts of a candidate that no base span covers, of WINDOW characters at least, as spans; covers are the
    candidate with the spans of each kind covered. Characters at a part's ends that join words (``/_=-+``) belong
    to it."""
    chars = F.split(covers[0], "", -1)
    for other in covers[1:]:
        chars = F.zip_with(chars, F.split(other, "", -1), lambda a, b: F.when(b == _COVER, b).otherwise(a))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(3).alias("kind"), part.alias("text"), part.alias("value"))
        return F.struct((end + 1).alias("at"), F.when(F.char_length(part) >= WINDOW, F.concat(acc["parts"], F.array(span))).otherwise(acc["parts"]).alias("parts"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,text:string,value:string>>)")
    return F.aggregate(F.split(F.array_join(chars, ""), _COVER, -1), F.struct(x["start"].alias("at"), none.alias("parts")), step, lambda acc: acc["parts"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: bool = False) -> DataFrame:
    """id, text (null: empty) and spans, array<struct<start,end,kind,text,value>> by start, then kind. With parts,
    what base spans leave of a candidate is scored too; otherwise a candidate that one touches is left out."""
    rows = pick(df, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("clean", F.translate("text", _OPEN + _CLOSE + _GROUP + _COVER, _OTHER * 4))
    rows = rows.select(
        "id",
        "text",
        _marked(F.col("clean"), ASSIGN, f"{_OPEN}$1{_GROUP}$2{_CLOSE}").alias("m0"),
        _marked(F.col("clean"), ACCESS, f"{_OPEN}$0{_CLOSE}").alias("m1"),
        _marked(F.col("clean"), HEX, f"{_OPEN}$0{_CLOSE}").alias("m2"),
        _marked(F.col("clean"), CANDIDATE, f"{_OPEN}$0{_CLOSE}").alias("m3"),
    )
    grouped = (True, False, False)
    rows = rows.select(
        "id",
        "text",
        *[f"m{k}" for k in range(3)],
        F.concat(F.filter(_spans(F.col("m0"), 0, True), lambda x: F.char_length(x["value"]) >= ASSIGN_MIN), _spans(F.col("m1"), 1, False), _spans(F.col("m2"), 2, False)).alias("base"),
        _spans(F.col("m3"), 3, False).alias("s3"),
    )
    # Candidates of the covered texts, which are those of the text itself; where there is anything to cover.
    both = (F.size("s3") > 0) & (F.size("base") > 0)
    covered = [F.when(both, F.regexp_extract_all(_covered(F.col(f"m{k}"), g), F.lit(COVERED), F.lit(0))).alias(f"c{k}") for k, g in enumerate(grouped)]
    rows = rows.select("id", "text", "base", "s3", both.alias("both"), *covered)
    # Side by side, as lambdas that reach for another column's arrays would compute them for each element.
    together = F.arrays_zip("s3", "c0", "c1", "c2")
    touched = lambda z: functools.reduce(lambda a, b: a | b, [F.instr(z[f"c{k}"], _COVER) > 0 for k in range(3)])
    left = F.transform(F.filter(together, lambda z: ~touched(z)), lambda z: z["s3"])
    if parts:
        left = F.flatten(F.transform(together, lambda z: F.when(touched(z), _uncovered(z["s3"], [z["c0"], z["c1"], z["c2"]])).otherwise(F.array(z["s3"]))))
    rows = rows.select("id", "text", "base", F.when(F.col("both"), left).otherwise(F.col("s3")).alias("s3"))
    added = F.filter("s3", lambda x: _suspicious(x["text"]))
    rows = rows.select("id", "text", "base", F.when(F.size("s3") > 0, added).otherwise(F.col("s3")).alias("added"))
    return rows.select("id", "text", F.array_sort(F.concat("base", "added")).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def order(spans: Column) -> Column:
    """By start, then kind."""
    key = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    return F.array_sort(F.transform(spans, key))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by mask (overlapping spans by one); other columns as they are.
    Rows without a span keep their very text, null included."""
    df, restore = unique_names(df)
    out = df.columns
    # the row travels as the id, so that no join back is needed
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in out]).alias("row"), F.col(text_col).alias("__text"))
    found = scan(named, "row", "__text", parts=True)

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    spans = order(F.col("spans"))
    masked = F.when(F.size("spans") > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col(f"id.{text_col}"))
    return restore(found.select(*[masked.alias(c) if c == text_col else F.col("id")[c].alias(c) for c in out]))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select(F.col("id").alias("doc_id"), order(F.col("spans")).alias("spans"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same for DuckDB: positions from pieces between marks, as above; entropies window by window."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    marks = "chr(57344)", "chr(57346)"

    def pieces(pattern: str, groups: bool) -> str:
        inner = f"'\\1' || {marks[1]} || '\\2'" if groups else "'\\0'"
        return f"string_split(regexp_replace(s, {quote(pattern)}, {marks[0]} || {inner} || {marks[0]}, 'g'), {marks[0]})"

    def spans(column: str, kind: int) -> str:
        at = f"list_transform({column}, lambda q: length(replace(q, {marks[1]}, '')))"
        start = "coalesce(list_sum(n[1 : i - 1]), 0)::INTEGER"
        struct = f"{{'s': {start}, 'k': {kind}, 'e': ({start} + n[i])::INTEGER, 'v': list_last(string_split({column}[i], {marks[1]}))}}"
        return f"list_transform(list_filter(range(1, len({column}) + 1), lambda i: i % 2 = 0), lambda i: {struct.replace('n[', f'({at})[')})"

    least = f"CASE WHEN regexp_matches(v, '^([0-9a-f]+|[0-9A-F]+)$') THEN {THRESHOLDS['hex']} WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN {THRESHOLDS['alnum']} ELSE {THRESHOLDS['base64']} END"
    chars = f"string_split(substr(x.v, (w + 1)::INTEGER, {WINDOW}), '')"
    count = f"len(list_filter({chars}, lambda z: z = c))"
    entropy = f"list_max(list_transform(range(length(x.v) - {WINDOW - 1}), lambda w: log2({WINDOW}) - list_sum(list_transform(list_distinct({chars}), lambda c: {count} * log2({count}))) / {WINDOW}))"
    said = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: ['assign', 'access', 'hex', 'entropy'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    short = lambda c: f"list_transform({c}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}})"
    kinds = ", ".join(f"len(list_filter(base, lambda x: x.k = {k}))::BIGINT AS n_{n}" for k, n in enumerate(KINDS[:3]))
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345) || chr(57346) || chr(57347), repeat(chr(65533), 4)) AS s FROM documents),
p AS (SELECT doc_id, {pieces(ASSIGN, True)} AS p0, {pieces(ACCESS, False)} AS p1, {pieces(HEX, False)} AS p2, {pieces(CANDIDATE, False)} AS p3 FROM t),
b AS (SELECT doc_id, list_filter({spans('p0', 0)}, lambda x: length(x.v) >= {ASSIGN_MIN}) || {spans('p1', 1)} || {spans('p2', 2)} AS base, {spans('p3', 3)} AS c FROM p),
f AS (SELECT doc_id, base, list_filter(c, lambda x: regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]') AND NOT regexp_matches(x.v, {quote(ALLOW)})
  AND len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0) AS c FROM b),
e AS (SELECT doc_id, base, list_filter(c, lambda x: {entropy} >= {least.replace('(v,', '(x.v,')}) AS added FROM f)
SELECT doc_id, {kinds}, sha256({said(short('base'))}) AS base_sha256, {said(short('base || added'))} AS spans FROM e
"""


OP10_SQL = _sql()
