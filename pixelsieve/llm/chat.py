r"""Chat formatting by schema fingerprints.

A record's layout is the sorted list of its nested field paths (``messages[].role``); the hash of that list is
its fingerprint. A registry of declarative mappings says, for each fingerprint, where the turns, their roles
and their texts are, so that prompts with responses, instructions with outputs and lists of messages all become
the same canonical turns. Paths that no mapping knows don't enter the fingerprint; a mapping's optional paths
may be missing.

Template: each turn is ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside texts are escaped: every
``<``, backslashes, ``|`` gets one backslash more, so that ``<|`` occurs in marks alone, and unescaping takes
one away. Roles are escaped likewise, their line ends and backslashes too.

Defined results: a null or missing text or role is empty; a record of an unknown layout gives one row with
mapping null and no turn (``formatted`` drops none of the others), and so does a record that is no JSON object, is
nested too deeply to be read, or whose list of messages has a member that is no object; a lone surrogate in a text
or role is U+FFFD; ids are kept as strings, and missing ones are null; records with whole conversations stay apart
whatever their ids, records with one turn each are one conversation by id (a null id is one too); a place that is no
whole number is null; a repeated turn is a turn; rows are ordered by conversation, turn (null first), then role and
text; an empty table gives no rows; other columns may clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, read, tidied

START, END = "<|im_start|>", "<|im_end|>"
_OPENING, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and where its text starts and ends in that."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; it must consist of turns alone."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns. `turns`: path of a list of messages, with the fields `role` and `text`; or
    `fields`: (path, role) of one turn each, in order, empty ones left out. `conversation` and `order` are paths
    of a turn's conversation and place, for layouts with one record a turn."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    conversation: str | None = None
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self):
        return {*self.required, *self.optional}

    @property
    def one_turn(self) -> bool:
        """Whether a record is one turn of a conversation."""
        return self.turns is None and not self.fields


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), role="role", text="text", conversation="conv_id", order="turn"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("id", "system"), turns="messages", role="role", text="content", fields=(("system", "system"),), conversation="id"),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), ("id", "system"), turns="conversations", role="from", text="value", fields=(("system", "system"),), conversation="id", roles=_SPEAKERS),
    Mapping("prompt_response", ("prompt", "response"), ("id", "system"), fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), conversation="id"),
    Mapping("prompt_completion", ("prompt", "completion"), ("id", "system"), fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), conversation="id"),
    Mapping("instruction", ("instruction", "output"), ("id", "input", "system"), fields=(("system", "system"), ("instruction", "user"), ("input", "+user"), ("output", "assistant")), conversation="id"),
    Mapping("question_answer", ("question", "answer"), ("id", "context"), fields=(("context", "system"), ("question", "user"), ("answer", "assistant")), conversation="id"),
)


def field_paths(value, at: str = "") -> set[str]:
    """The paths of a record's leaves; list members share one path, empty lists and objects have their own."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Registry:
    """Mappings by fingerprint: one for each choice of a mapping's optional paths."""

    def __init__(self, mappings=MAPPINGS):
        self.known = set().union(*(m.paths() for m in mappings))
        self.by: dict[str, Mapping] = {}
        for m in mappings:
            for n in range(len(m.optional) + 1):
                for some in itertools.combinations(m.optional, n):
                    print_ = fingerprint({*m.required, *some})
                    if self.by.setdefault(print_, m) is not m:
                        raise ValueError(f"{m.name} and {self.by[print_].name} have the same paths")

    def fingerprint(self, record) -> str:
        return fingerprint(field_paths(record) & self.known)

    def turns(self, record) -> tuple[str, str | None, list[tuple]]:
        """Fingerprint, mapping name, and (conversation, order, role, text) of each turn."""
        found = self.fingerprint(record)
        m = self.by.get(found)
        if m is None:
            return found, None, []
        conversation = _name(record.get(m.conversation)) if m.conversation else None
        said = lambda v: "" if v is None else _valid(v) if isinstance(v, str) else _json(v)
        role = lambda v: m.roles.get(said(v), said(v))
        out: list[list] = []
        if m.one_turn:
            return found, m.name, [(conversation, _whole(record.get(m.order)), role(record.get(m.role)), said(record.get(m.text)))]
        for path, who in m.fields:
            text = said(record.get(path))
            if path not in record or (text == "" and path not in m.required):
                continue
            if who[0] == "+":
                out[-1][1] += "\n\n" + text
            else:
                out.append([who, text])
        items = (record.get(m.turns) or []) if m.turns else []
        if not all(isinstance(item, dict) for item in items):
            return found, None, []
        for item in items:
            out.append([role(item.get(m.role)), said(item.get(m.text))])
        return found, m.name, [(conversation, k, r, t) for k, (r, t) in enumerate(out)]


def _valid(text: str) -> str:
    """text as UTF-8 can hold it."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _json(value) -> str:
    return _valid(json.dumps(value, ensure_ascii=False))


def _name(value) -> str | None:
    """An id as a string."""
    return value if value is None else _valid(value) if isinstance(value, str) else _json(value)


def _whole(value) -> int | None:
    """A place as a 64-bit number."""
    if isinstance(value, float) and value.is_integer() or isinstance(value, str) and re.fullmatch(r"\s*-?[0-9]{1,18}\s*", value):
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def _record(said: str | None):
    """The JSON record, None where there is none."""
    try:
        record = json.loads(said) if said is not None else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


_TURN_ROWS = {
    "conversation": pa.string(), "record_no": pa.int64(), "turn": pa.int64(), "role": pa.string(), "formatted": pa.string(), "text_start": pa.int64(), "text_end": pa.int64(), "trained": pa.bool_(), "layout": pa.string(), "mapping": pa.string(),
    "whole": pa.bool_(),
}
_FORMATTED = "conversation string, record_no long, turn long, role string, formatted string, text_start long, text_end long, trained boolean, layout string, mapping string, whole boolean"


def as_records(df: DataFrame) -> DataFrame:
    """Each row of df as one JSON record, nulls included; of columns with one name the first counts."""
    names, chosen = [f"c{k}" for k in range(len(df.columns))], {}
    for inner, name in zip(names, df.columns, strict=True):
        chosen.setdefault(name, inner)
    return df.toDF(*names).select(F.to_json(F.struct(*[F.col(i).alias(n) for n, i in chosen.items()]), {"ignoreNullFields": "false"}).alias("record"))


def format_turns(records: DataFrame, record_col: str = "record", mappings=MAPPINGS, trained_role: str = "assistant") -> DataFrame:
    """A row for each canonical turn of JSON records: the turn as formatted and, as text_start to text_end (code
    points of the formatted turn), its text; trained says that this span is under the loss mask. `layout` is the
    record's fingerprint; `whole` says that the record is a whole conversation, not a turn of one. A conversation's
    formatted text is that of its turns, in order, nothing between: of one record_no where whole, else of one
    conversation."""
    registry = None

    def run(batches):
        nonlocal registry
        registry = registry or Registry(mappings)
        for b in batches:
            rows = []
            for said, no in zip(b.column("record").to_pylist(), b.column("no").to_pylist(), strict=True):
                record = _record(said)
                try:
                    found, name, turns = registry.turns(record) if record is not None else (None, None, [])
                except RecursionError:
                    found, name, turns = None, None, []
                if name is None:
                    rows.append((None, no, None, None, None, None, None, None, found, None, None))
                    continue
                whole = not registry.by[found].one_turn
                for conversation, turn, role, text in turns:
                    formatted, lo, hi = render(role, text)
                    rows.append((conversation, no, turn, role, formatted, lo, hi, role == trained_role, found, name, whole))
            if rows:
                yield batch(list(_TURN_ROWS), list(_TURN_ROWS.values()), list(zip(*rows, strict=True)))

    src = records.select(F.col(record_col).alias("record"), F.monotonically_increasing_id().alias("no"))
    return src.mapInArrow(tidied(run), _FORMATTED)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conversation, record_no (null unless the record is a whole conversation), n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars, read back from formatted turns.

    Turns stream by conversation, in order, through running hashes, so that a very long conversation takes no
    more memory than a short one."""

    def run(batches):
        names = ["conversation", "record_no", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now = None
        n = loss = chars = 0
        every = masked = None
        out = []
        for b in batches:
            for conv, no, formatted, lo, hi, trained in zip(*(b.column(c).to_pylist() for c in ("conversation", "of", "formatted", "text_start", "text_end", "trained")), strict=True):
                if (conv, no) != now:
                    if now:
                        out.append((*now, n, every.hexdigest(), loss, masked.hexdigest(), chars))
                    now, n, loss, chars, every, masked = (conv, no), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(formatted):
                    n += 1
                    every.update(f"{role}\n{text}\n".encode())
                if trained:
                    text = unescape(formatted[lo:hi])
                    loss += len(text)
                    masked.update(text.encode())
                chars += len(formatted)
            if len(out) >= 5000:
                yield batch(names, types, list(zip(*out, strict=True)))
                out = []
        if now:
            out.append((*now, n, every.hexdigest(), loss, masked.hexdigest(), chars))
        if out:
            yield batch(names, types, list(zip(*out, strict=True)))

    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.filter("mapping is not null").select("conversation", F.when(F.col("whole"), F.col("record_no")).alias("of"), "turn", "role", "formatted", "text_start", "text_end", "trained")
    rows = rows.repartition(tasks, "conversation", "of").sortWithinPartitions("conversation", "of", "turn", "role", "formatted")
    return rows.mapInArrow(tidied(run), "conversation string, record_no long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    digests = conversation_digests(format_turns(as_records(rows.unionByName(probe))))
    return digests.select(F.col("conversation").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
