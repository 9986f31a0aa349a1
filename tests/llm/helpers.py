from pathlib import Path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, tmp_path: Path, rows, table="documents", schema=DOCS, repeat=1):
    """A data folder with one table; its path."""
    where = tmp_path / f"data{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame(rows, schema).write.parquet(f"{where}/{table}.parquet")
    return str(where)


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text))


EDGE_TEXTS = [None, "", " \n\t", "a", "Hello, World!", "same text here", "same text here", "é" * 50, "日本語テキスト", "x" * 70000, "word " * 9000, "\U0001f600 tail \x0b"]
