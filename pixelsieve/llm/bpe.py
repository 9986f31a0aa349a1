r"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

Greedy BPE has this property: of all tokens that end a prefix of a word, exactly one is the last token of that
prefix's own encoding, and it is the one that (a) the encoding of the shorter prefix before it ends in a token
with which it forms a compatible pair. A pair is compatible when encoding the two tokens' joined text gives
back these two tokens. So one pass over a word, with the tokens that end at each place (an automaton over the
vocabulary with suffix links gives them, longest first), stores the last token of every prefix; following the
stored tokens back from the word's end gives the ids.

The vocabulary file is one of the `tokenizers` library: NFC, white space, lower case, a split into words, a
byte alphabet, and merges whose last symbol carries an end-of-word mark.

Defined results: null and empty text have no tokens and decode to the empty string; texts are never cut; the
strings of special tokens inside a text become those tokens, as in the library; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, pick, read, remember_for, slices, tidied

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Words whose encoding a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
REMEMBERED_PAIRS = 1_500_000
_END = "\x00"  # stands for the end-of-word mark; no symbol of the byte alphabet

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The words of a normalised text; the first two are the third's cases for ASCII and Latin-1.
_ASCII = re.compile(_CONTRACTIONS + r"|[a-zA-Z]+|[0-9]|[^\t-\r a-zA-Z0-9]+")
_LATIN = re.compile(_CONTRACTIONS + r"|[a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff0-9²³¹¼½¾]+")
_ANY = regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Blocks whose letters, digits and cases are the same in every Unicode version that is in use.
_SETTLED = re.compile("[^\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u22ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff]")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next above 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case character by character, without regard to neighbours."""
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def unsettled_words(text: str, path: str) -> list[str]:
    """As words(), with the library's own normaliser and splitter, for texts with rare characters whose
    properties differ between Unicode versions."""
    lib = _library(path)
    code = {c: b for b, c in enumerate(byte_alphabet())}
    split = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
    return [bytes(code[c] for c in piece).decode("utf-8") for piece, _ in split]


def words(text: str, path: str | None = None) -> list[str]:
    """The words of an ordinary text (without special tokens), normalised."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _SETTLED.search(text):
            return unsettled_words(text, path or vocabulary_path())
        return _ANY.findall(lower(unicodedata.normalize("NFC", text)))
    return _LATIN.findall(text.lower())


class Vocabulary:
    """Tokens, merges and the prefix encoder of one vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        self.strings: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.special.items()}
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._alphabet = byte_alphabet()
        ids = {self._inner(t, mark): i for t, i in model["vocab"].items()}
        self._length = {i: len(t) for t, i in ids.items()}
        self._automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self._automaton.add_word(t, (i, len(t)))
        self._automaton.make_automaton()
        self._rank = dict.fromkeys(ids.values(), -1)
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        self._pair: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for rank, (a, b) in enumerate(model["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b] if not a.endswith(mark) else vocab[a[: -len(mark)] + b]
            self._pair.setdefault(pair, rank)
            if self._rank[whole] < 0:
                self._rank[whole] = rank
                self._left[whole], self._right[whole] = pair
        self._compatible: dict[int, bool] = {}

    @staticmethod
    def _inner(token: str, mark: str) -> str:
        return token[: -len(mark)] + _END if token.endswith(mark) and len(token) > len(mark) else token

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of a and b together is encoded as these two tokens.

        The right edge of a and the left edge of b are taken apart again, latest merge first. Where the two
        edges form a pair that merges before either edge is merged on, the border between them would vanish;
        of two equal merges the left one comes first."""
        key = a << 20 | b
        known = self._compatible.get(key)
        if known is not None:
            return known
        until_a = until_b = len(self._pair) + 1
        out = True
        while True:
            rank = self._pair.get((a, b))
            if rank is not None and rank < until_a and rank <= until_b:
                out = False
                break
            rank_a, rank_b = self._rank[a], self._rank[b]
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                until_a, a = rank_a, self._right[a]
            else:
                until_b, b = rank_b, self._left[b]
        if len(self._compatible) >= REMEMBERED_PAIRS:
            self._compatible.clear()
        self._compatible[key] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """The ids of one normalised word."""
        text = "".join([self._alphabet[b] for b in word.encode("utf-8")]) + _END
        n = len(text)
        last: list[int] = [-1] * (n + 1)
        compatible, known = self.compatible, self._compatible
        for at, (token, length) in self._automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if end == length or (before >= 0 and (known.get(before << 20 | token) if (before << 20 | token) in known else compatible(before, token))):
                last[end] = token
        out = []
        while n > 0:
            token = last[n]
            out.append(token)
            n -= self._length[token]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self._special_split is None or "<|" not in text:
            return words(text, self.path)
        out: list[str] = []
        for k, part in enumerate(self._special_split.split(text)):
            if k % 2:
                out.append(_END + part)  # no word starts so
            else:
                out += words(part, self.path)
        return out

    def encode_piece(self, piece: str) -> list[int]:
        return [self.special[piece[1:]]] if piece[:1] == _END and piece[1:] in self.special else self.encode_word(piece)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens: without a decoder, tokens are joined by a space."""
        return " ".join([self.strings[i] for i in ids])


class Remembered(dict):
    """Values by piece, computed when first asked for. Two generations bound their number: when the younger is
    full it becomes the older one, and what is asked for again moves up."""

    def __init__(self, fn, most: int = REMEMBERED):
        super().__init__()
        self.fn, self.most, self.older = fn, most // 2, {}

    def __missing__(self, piece):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(piece)
        if value is None:
            value = self.fn(piece)
        self[piece] = value
        return value


@remember_for(__name__, "pixelsieve.llm.packing")
@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@remember_for(__name__)
@functools.lru_cache(maxsize=1)
def remembered_pieces(path: str) -> Remembered:
    """By piece, its ids (decimal, joined by a space) and their decoded text; one for all tasks of a worker."""
    vocab = vocabulary(path)

    def both(piece: str) -> tuple[str, str]:
        ids = vocab.encode_piece(piece)
        return " ".join(map(str, ids)), vocab.decode(ids)

    return Remembered(both)


def _encoded(path: str):
    def run(batches):
        vocab, remembered = vocabulary(path), remembered_pieces(path)
        names, types = ["id", "n_tokens", "ids", "decoded"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
        # a few texts at a time, as ids take more room than the text
        for b in slices(batches, 64):
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                pairs = [remembered[p] for p in vocab.pieces(text or "")]
                said = " ".join([p[0] for p in pairs])
                rows.append((i, said.count(" ") + 1 if pairs else 0, said, " ".join([p[1] for p in pairs])))
            yield batch(names, types, list(zip(*rows, strict=True)))

    return tidied(run)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids (decimal, joined by a space) and decoded, a row for each input row."""
    path = path or vocabulary_path()
    return pick(df, id=id_col, text=text_col).mapInArrow(_encoded(path), "id long, n_tokens long, ids string, decoded string")


def _digests(path: str):
    inner = _encoded(path)

    def run(batches):
        names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
        sha = lambda c: [hashlib.sha256(x.encode()).hexdigest() for x in c.to_pylist()]
        for b in inner(batches):
            yield batch(names, types, [b.column("id"), b.column("n_tokens"), sha(b.column("ids")), sha(b.column("decoded"))])

    return tidied(run)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of encode_decode(), taken in the same pass, so that ids needn't go through the JVM."""
    docs = pick(read(spark, sf_dir, "documents"), id="doc_id", text="text").withColumn("id", F.col("id").cast("long"))
    return docs.mapInArrow(_digests(vocabulary_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
