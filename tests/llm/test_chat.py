import hashlib
import json
import re

import duckdb
import pytest
from helpers import SF, save
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelsieve.llm import chat as X

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "im_end", "|>", "<|", "\n", "a", "<|im_end|>", "\\n", "é"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_reversible(role, text):
    assert X.unescape(X.escape(text)) == text and X.unescape_role(X.escape_role(role)) == role
    assert "<|" not in X.escape(text)
    whole = "".join(X.render(r, t)[0] for r, t in [(role, text), ("assistant", text + "x")])
    assert X.parse(whole) == [(role, text), ("assistant", text + "x")]


def test_parse_rejects_other_text():
    with pytest.raises(ValueError):
        X.parse("x" + X.render("user", "a")[0])


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "messages": [{"role": "user", "content": None}]}, "messages", [("system", "s"), ("user", "")]),
    ({"id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "sharegpt", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r", "url": "x"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r"}, "prompt_completion", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("system", "c"), ("user", "q"), ("assistant", "a")]),
    ({"conv_id": 1, "turn": 0, "role": "user", "text": None}, "turn_rows", [("user", "")]),
    ({"unknown": 1}, None, []),
    ({"messages": []}, None, []),
]


def test_layouts(spark):
    registry = X.Registry()
    for record, name, turns in LAYOUTS:
        found = registry.turns(record)
        assert found[1] == name and [t[2:] for t in found[2]] == turns
    assert registry.fingerprint({"b": 1, "prompt": 1, "response": 2}) == registry.fingerprint({"response": None, "prompt": "x"})
    records = spark.createDataFrame([(json.dumps(r),) for r, _, _ in LAYOUTS] + [("not json",), (None,), ("[1]",)], "record string")
    out = X.format_turns(records).collect()
    assert sum(r["mapping"] is None for r in out) == 5 and sum(r["mapping"] is not None for r in out) == sum(len(t) for _, _, t in LAYOUTS)
    for r in out:
        if r["mapping"]:
            (role, text) = X.parse(r["formatted"])[0]
            assert X.unescape(r["formatted"][r["text_start"] : r["text_end"]]) == text and r["trained"] == (role == "assistant")


def texts(spark, records):
    """By conversation of the digests' source: id, and (role, text) of its turns."""
    turns = X.format_turns(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "record string"))
    out = {}
    for r in sorted(turns.filter("mapping is not null").collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["formatted"])):
        out.setdefault((r["conversation"], r["record_no"] if r["whole"] else None), []).append(X.parse(r["formatted"])[0])
    digests = X.conversation_digests(turns).collect()
    assert sorted((str(d["conversation"]), str(d["record_no"]), d["n_turns"]) for d in digests) == sorted((str(c), str(n), len(t)) for (c, n), t in out.items())
    for d in digests:
        said = out[d["conversation"], d["record_no"]]
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256("".join(t for r, t in said if r == "assistant").encode()).hexdigest()
    return sorted((c, t) for (c, _), t in out.items() if c is not None), sorted(t for (c, _), t in out.items() if c is None)


def test_all_layouts_in_one_table(spark):
    """Records of the seven layouts mixed: one conversation each, but for turns that are rows."""
    known = [(r, t) for r, name, t in LAYOUTS if name and name != "turn_rows"]
    rows = [{"conv_id": c, "turn": k, "role": "assistant" if k % 2 else "user", "text": f"{c}{k}"} for c in (1, "1b") for k in range(3)]
    named, unnamed = texts(spark, [r for r, _ in known] + rows)
    assert len(named) == 3 and ("1b", [("user", "1b0"), ("assistant", "1b1"), ("user", "1b2")]) in named and ("4", [("user", "q"), ("assistant", "a")]) in named
    assert unnamed == sorted(t for r, t in known if "id" not in r)


def test_ids_keep_conversations_apart(spark):
    pair = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    said = [("user", "q"), ("assistant", "a")]
    assert texts(spark, [pair | {"id": "x"}, pair | {"id": "y"}]) == ([("x", said), ("y", said)], [])
    assert texts(spark, [pair, pair]) == ([], [said, said])
    assert texts(spark, [pair | {"id": 7}, pair | {"id": 7}]) == ([("7", said), ("7", said)], [])
    assert texts(spark, [pair | {"id": 2**70}]) == ([(str(2**70), said)], [])


def test_records_that_are_no_conversation(spark):
    good = {"prompt": "p", "response": "r"}
    bad = ['{"messages": [{"role": "user", "content": "q"}, "text"]}', '{"messages": [{"role": "user", "content": "q"}, null]}', "[" * 100000 + "]" * 100000, '{"prompt": ' * 5000 + "1" + "}" * 5000, '{"prompt": 1' + "0" * 5000 + "}", "{", ""]
    assert texts(spark, [good, *bad]) == ([], [[("user", "p"), ("assistant", "r")]])
    out = X.format_turns(spark.createDataFrame([(b,) for b in bad], "record string")).collect()
    assert [r["mapping"] for r in out] == [None] * len(bad)


def test_surrogates_and_places(spark):
    assert texts(spark, [r'{"prompt": "a\ud800b", "response": "\ud83d\ude00", "id": "\udc00"}']) == ([("\ufffd", [("user", "a\ufffdb"), ("assistant", "\U0001f600")])], [])
    places = [("x", "a"), (None, "b"), (True, "c"), (2**80, "d"), (1.5, "e"), (0.0, "f"), ("1", "g"), (2, "h")]
    found, _ = texts(spark, [{"conv_id": 1, "turn": t, "role": "user", "text": x} for t, x in places])
    assert [t for _, t in found[0][1]][5:] == ["f", "g", "h"] and len(found[0][1]) == 8


def test_same_paths_are_refused():
    with pytest.raises(ValueError):
        X.Registry((X.Mapping("a", ("x",), fields=(("x", "user"),)), X.Mapping("b", ("x",), fields=(("x", "user"),))))


def want(rows):
    rows = [*rows, (-1, 0, "user", X.PROBE), (-1, 1, "assistant", X.PROBE)]
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = [t[2] for t in turns if t[1] == "assistant"]
        chars = sum(24 + len(t[1]) + len(t[2]) + len(re.findall(r"<\\*\|", t[2])) for t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{t[1]}\n{t[2]}\n" for t in turns)), len("".join(said)), sha("".join(said)), chars))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n"), (2, 0, None, None), (3, 1, "assistant", "é" * 9), (3, 0, "system", ""), (None, 0, "user", "x"), (4, None, "user", "y"), (4, 2, "assistant", "z")]
    rows += [(5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "long " * 50000)]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    got = sorted((tuple(r) for r in X.op1_chat(spark, save(spark, tmp_path, rows, "conversations", SCHEMA)).collect()), key=str)
    assert got == want(rows)
    assert len(X.op1_chat(spark, save(spark, tmp_path, [], "conversations", SCHEMA)).collect()) == 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", 5)], "conv_id long, turn long, role string, text string, formatted long").selectExpr("*", "'x' as role")
    assert [r["formatted"] for r in X.format_turns(X.as_records(df)).collect()] == [X.render("user", "hi")[0]]


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(con.execute(X.OP1_SQL).fetchall()) == sorted(tuple(r) for r in X.op1_chat(spark, SF).select(cols).collect())
