import hashlib
import random

import pytest
from helpers import EDGE_TEXTS, SF, doc, save
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelsieve.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.vocabulary_path())


def both(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, ascii(text)
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


CASES = [
    "ΑΣ ΟΔΟΣ Σ", "İI ı", "<|endoftext|>x<|startoftext|>a<|foo|>", "don't we'LL ''s -'s I'd've", "é ́", "\x85a\xa0b\x1cc\x00d",
    "aaaaaaaaaaa" * 30, "\U0001f600‍ x", "ﬁ Ⅷ ² ½ ª", "1234567", "ᲉꟋ a՘b", "한국어 日本語 ไทย हिन्दी", "œuvre — “quoted” …",
]


@pytest.mark.parametrize("text", [t for t in EDGE_TEXTS if t is not None] + CASES)
def test_cases(library, own, text):
    both(library, own, text)


def test_random_words(library, own):
    rng = random.Random(5)
    for _ in range(4000):
        both(library, own, "".join(rng.choice("aabcdeeinorst'") for _ in range(rng.randrange(1, 25))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, own, text):
    both(library, own, text.encode("utf-8", "ignore").decode())


def test_prefix_property(own):
    """The stored last token of each prefix is that of the prefix's own encoding."""
    ids = own.encode_word("internationalization")
    assert own.compatible(ids[0], ids[1]) if len(ids) > 1 else True
    assert "".join(own.strings[i] for i in ids) == "internationalization</w>"


def test_memory_is_bounded():
    calls = []
    r = bpe.Remembered(lambda x: calls.append(x) or x, most=4)
    assert [r[k] for k in [1, 2, 1, 3, 4, 5, 1]] == [1, 2, 1, 3, 4, 5, 1] and len(r) <= 2 and len(r.older) <= 2


def test_query(spark, library, tmp_path):
    rows = [doc(i, t) for i, t in enumerate(EDGE_TEXTS)] + [doc(5, "again"), doc(5, "again")]
    got = sorted(tuple(r) for r in bpe.op8_bpe(spark, save(spark, tmp_path, rows)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.op8_bpe(spark, save(spark, tmp_path, [])).count() == 0
    out = bpe.encode_decode(spark.read.parquet(f"{SF}/documents.parquet").limit(5)).collect()
    assert all(len(r["ids"].split()) == r["n_tokens"] for r in out)
