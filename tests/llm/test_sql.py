"""Queries against the same in SQL, on the smallest tables and on planted cases."""

import os

import duckdb
import pytest
from helpers import EDGE_TEXTS, SF, doc, save
from test_secrets import PLANTED

from pixelsieve.llm import queries as q


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(spark, folder, name):
    cur = connect(folder).execute(q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = q.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_sample(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", [n for n in q.oracle_sql() if n != "op1_chat"])
def test_planted(spark, tmp_path, name):
    texts = [t for t in EDGE_TEXTS if t is None or len(t) < 9000] + PLANTED + ["same text  here", "SAME TEXT HERE"]
    same(spark, save(spark, tmp_path, [doc(i, t, source=f"s{i % 3}") for i, t in enumerate(texts)]), name)
