"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram's vector binds the letters' vectors, each permuted by its
place (componentwise product of rotated vectors). A document's vector bundles (adds up) the vectors of its
trigrams, a language's prototype those of its training documents; the prediction is the prototype with the
largest cosine. A text's letters are lower-cased; everything between two words counts as one blank letter.

Training adds up whole-number vectors in Spark, so that its result doesn't depend on how rows are spread; the
driver receives DIMENSIONS numbers a language. The sums cover all labelled documents, without a sample.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without a label don't
train; without any labelled text every prediction is ``und``; equal cosines go to the first language by name;
the score is the cosine, 0 where negative; texts are read whole; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm.common import batch, pick, read, slices, tidied, unique_names

DIMENSIONS = 1024
SEED = 7
#: Trigram vectors that a worker remembers.
REMEMBERED = 16_000
UNKNOWN = "und"
#: A text of at least so many letters is in none of the learned languages below this cosine to every prototype;
#: in shorter ones a low cosine says nothing.
REJECT_BELOW = 0.1
REJECT_LETTERS = 200
#: Cosines of unrelated texts stay below this (four standard deviations); a bound that isn't above it is not applied.
NOISE = 4 / DIMENSIONS**0.5
#: A band of lengths with fewer labelled texts takes in the shorter bands before it.
BAND_TEXTS = 20


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=65536)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_vector(key: int) -> np.ndarray:
    a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, as numbers, and how often each occurs; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, 0).astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    return np.unique(keys, return_counts=True)


class Profiles:
    """Vectors of trigrams, remembered as rows of one matrix."""

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, DIMENSIONS), np.float32)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors; exact, as sums of whole numbers below 2**24 a block."""
        out = np.zeros(DIMENSIONS)
        for lo in range(0, len(keys), 8192):
            places = self._places(keys[lo : lo + 8192].tolist())
            out += counts[lo : lo + 8192].astype(np.float32) @ self.matrix[places]
        return out

    def _places(self, keys: list[int]) -> list[int]:
        rows = self.rows
        new = [k for k in keys if k not in rows]
        if new:
            if len(rows) + len(new) > REMEMBERED:
                rows.clear()
                new = keys
            need = len(rows) + len(new)
            if need > len(self.matrix):
                grown = np.empty((min(max(need, 2 * len(self.matrix)), max(need, REMEMBERED)), DIMENSIONS), np.float32)
                grown[: len(rows)] = self.matrix[: len(rows)]
                self.matrix = grown
            for k in new:
                self.matrix[len(rows)] = trigram_vector(k)
                rows[k] = len(rows)
        return [rows[k] for k in keys]


@tidied
def _sums(batches):
    """For each language the trigram counts of this task's texts, bundled at the end."""
    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[str, int] = {}

    def merge(lang: str) -> None:
        keys = np.concatenate([k for k, _ in counts[lang]])
        n = np.concatenate([c for _, c in counts[lang]])
        unique, place = np.unique(keys, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, place, n)
        counts[lang], held[lang] = [(unique, total)], 0

    for b in slices(batches):
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            keys, n = trigrams(text)
            if len(keys):
                counts.setdefault(lang, []).append((keys, n))
                held[lang] = held.get(lang, 0) + len(keys)
                if held[lang] > 400_000:
                    merge(lang)
    at = np.arange(DIMENSIONS, dtype=np.int32)
    for lang in counts:
        merge(lang)
        keys, n = counts[lang][0]
        total = np.zeros(DIMENSIONS, np.int64)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            total += c * trigram_vector(k).astype(np.int64)
        yield batch(["lang", "at", "total"], [pa.string(), pa.int32(), pa.int64()], [[lang] * DIMENSIONS, at, total])


def _totals(df: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    rows = pick(df, text=text_col, lang=lang_col).filter("text is not null and lang is not null")
    sums = rows.mapInArrow(_sums, "lang string, at int, total long").groupBy("lang", "at").agg(F.sum("total").alias("total"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS numbers a language
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["total"]
    return {lang: v for lang, v in sorted(found.items()) if v.any()}


def _unit(totals: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {lang: v / np.linalg.norm(v) for lang, v in totals.items()}


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype for each language of the labelled rows."""
    return _unit(_totals(df, text_col, lang_col))


def letters(text: str | None) -> int:
    return sum(map(str.isalpha, text or ""))


def _band(n: int) -> int:
    """Bands of lengths in letters: 1, 2 to 3, 4 to 7, ..."""
    return n.bit_length() - 1


def _least(totals: dict[str, np.ndarray]):
    """By band, how many labelled texts a task has and their least best cosine; a text doesn't count in its own
    language's prototype."""
    langs = list(totals)
    matrix = np.array([totals[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))
    squares = (matrix * matrix).sum(axis=1)

    def run(batches):
        profiles = Profiles()
        found: dict[int, tuple[int, float]] = {}
        for b in slices(batches, 1024):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                keys, counts = trigrams(text)
                if not len(keys) or lang not in totals:
                    continue
                v = profiles.bundle(keys, counts)
                vv, dots, rest = v @ v, matrix @ v, squares.copy()
                own = langs.index(lang)
                rest[own] += vv - 2 * dots[own]
                dots[own] -= vv
                cosines = np.where(rest > 0, dots / np.sqrt(np.maximum(rest, 1) * (vv or 1.0)), 0.0)
                n, least = found.get(_band(letters(text)), (0, 1.0))
                found[_band(letters(text))] = (n + 1, min(least, float(cosines.max())))
        if found:
            n, least = zip(*found.values(), strict=True)
            yield batch(["band", "n", "least"], [pa.int32(), pa.int64(), pa.float64()], [list(found), n, least])

    return tidied(run)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[dict[str, np.ndarray], dict[int, float]]:
    """Prototypes, and by band of lengths the least cosine that a labelled text has without itself. Bands whose
    least cosine noise reaches have no bound. All labelled rows count."""
    totals = _totals(df, text_col, lang_col)
    rows = pick(df, text=text_col, lang=lang_col).filter("text is not null and lang is not null")
    least = rows.mapInArrow(_least(totals), "band int, n long, least double").groupBy("band").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    seen = {r["band"]: (r["n"], r["least"]) for r in least.collect()}  # a few dozen bands
    bounds = {}
    for band in range(max(seen, default=-1) + 1):
        n, bound = 0, 1.0
        for below in range(band, -1, -1):
            if n >= BAND_TEXTS:
                break
            if below in seen:
                n, bound = n + seen[below][0], min(bound, seen[below][1])
        if n and bound > NOISE:
            bounds[band] = bound
    return _unit(totals), bounds


def _predicted(prototypes: dict[str, np.ndarray]):
    langs = list(prototypes)
    matrix = np.array([prototypes[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))

    def run(batches):
        profiles = Profiles()
        for b in slices(batches, 1024):
            said, scores = [], []
            for text in b.column("text").to_pylist():
                keys, counts = trigrams(text) if text else (np.zeros(0), None)
                if len(keys) and langs:
                    v = profiles.bundle(keys, counts)
                    cosines = matrix @ v / (np.linalg.norm(v) or 1.0)
                    k = int(np.argmax(cosines))
                    said.append(langs[k])
                    scores.append(min(1.0, max(0.0, float(cosines[k]))))
                else:
                    said.append(UNKNOWN)
                    scores.append(0.0)
            others = [n for n in b.schema.names if n != "text"]
            arrays = [b.column(n) for n in others] + [pa.array(said, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "lang_pred", "score"])

    return tidied(run)


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score; a row for each input row. Only the text decides."""
    rows = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(_predicted(prototypes), "id long, lang_pred string, score double")


def keep_known(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", reject_below: float = REJECT_BELOW, bounds: dict[int, float] | None = None) -> DataFrame:
    """The rows of df in one of the learned languages, with all their columns. Rejected are texts without a
    letter, texts of REJECT_LETTERS letters or more that resemble no prototype, and texts below the bound of their
    band of lengths; texts longer than all bands have the longest one's."""
    df, restore = unique_names(df)
    schema = df.schema
    langs = _predicted(prototypes)
    longest = max(bounds or {}, default=0)

    def stays(score: float, n: int) -> bool:
        if n >= REJECT_LETTERS and score < reject_below:
            return False
        return score >= (bounds or {}).get(min(_band(n), longest), 0.0) - 1e-9

    def run(batches):
        texts_of = lambda b: pa.RecordBatch.from_arrays([b.column(b.schema.names.index(text_col))], names=["text"])
        ahead, again = itertools.tee(slices(batches, 1024))
        for b, got in zip(again, langs(map(texts_of, ahead)), strict=True):
            at = b.schema.names.index(text_col)
            said, scores, texts = got.column("lang_pred").to_pylist(), got.column("score").to_pylist(), b.column(at).to_pylist()
            keep = [p != UNKNOWN and stays(s, letters(t)) for p, s, t in zip(said, scores, texts, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return restore(df.mapInArrow(tidied(run), schema))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = train(docs.filter(~held_out()))
    out = predict(docs, prototypes)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
