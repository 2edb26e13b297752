"""Language identification with string kernels.

Kernel: two texts share what n-grams of letters (n = 1 to 3, blended; lower case, every other character
a space) are present in both, normalised by the number in each. N-grams of any script are hashed into one
space of 2^20. Nyström: the kernel is evaluated against a few landmark texts for each language, over the
n-grams that landmarks hold. Classifier: one-versus-rest kernel ridge regression on a bounded sample of
labelled texts, fitted on the driver. Scoring goes by batches: the product of two sparse presence matrices
(texts x n-grams and n-grams x landmarks) and then a product with the regression's weights.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, mapped, slices, text_or_empty, without_reserved

UNDETERMINED = "und"
#: Bounds of the fit: labelled texts of a language and landmarks among these; characters of the piece that is looked at of
#: each; and both sums over all languages, which share them evenly where there are very many (at least one each).
TEXTS, LANDMARKS, PIECE, MOST_TEXTS, MOST_LANDMARKS = 160, 24, 4000, 16_000, 3_200
RIDGE, SHARPNESS = 1e-3, 4.0
GRAM_BITS = 20
#: Texts scored by one product, characters of a text looked at in one go, bytes of text in one go.
ROWS, CHARS, BYTES = 256, 1 << 18, 1 << 20
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_indexes: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Model:
    """languages: of the weights' columns; grams: sorted codes of the landmarks' n-grams; starts, marks: by n-gram the landmarks
    that hold it (of n-gram k, marks[starts[k] : starts[k + 1]]); sizes: n-grams of each landmark; weights: landmarks x languages."""

    languages: tuple[str, ...]
    grams: np.ndarray
    starts: np.ndarray
    marks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    @property
    def name(self) -> str:
        return hashlib.md5(repr(self.languages).encode() + self.grams.tobytes() + self.weights.tobytes(), usedforsecurity=False).hexdigest()


@cache
def _letters() -> np.ndarray:
    """Of every code point: itself if it is a letter, else 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[~np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 0
    return table


def codes(text: str):
    """(whether there is a letter, codes of the 1-, 2- and 3-grams), chunk by chunk."""
    table, shift = _letters(), np.uint32(32 - GRAM_BITS)
    low = text.lower()
    for at in range(0, max(len(low), 1), CHARS):
        x = table[np.frombuffer(low[max(0, at - 2) : at + CHARS].encode("utf-32-le", "replace"), np.uint32)]
        one, two = x * _M1, x[:-1] * _M1 + x[1:] * _M2 + np.uint32(2)
        three = two[:-1] + x[2:] * _M3 + np.uint32(1)
        yield bool(x.any()), tuple(((h ^ (h >> np.uint32(15))) * _M2) >> shift for h in (one, two, three))


def grams(text: str) -> np.ndarray:
    """The distinct codes in ``text``, sorted."""
    return np.unique(np.concatenate([c for _, three in codes(text) for c in three]))


def _index(model: Model) -> np.ndarray:
    """Code to place among the model's n-grams, the number of these for all others: kept for one model in each Python worker."""
    if model.name not in _indexes:
        _indexes.clear()
        index = np.full(1 << GRAM_BITS, len(model.grams), np.int32)
        index[model.grams] = np.arange(len(model.grams), dtype=np.int32)
        _indexes[model.name] = index
    return _indexes[model.name]


def kernel(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(texts x landmarks, whether a text has a letter)."""
    index, letter, held = _index(model), np.zeros(len(texts), bool), []
    flags = np.zeros(len(model.grams) + 1, bool)
    for k, text in enumerate(texts):
        for any_letter, three in codes(text):
            letter[k] |= any_letter
            for c in three:
                flags[index[c]] = True
        held.append(np.flatnonzero(flags[:-1]))
        flags[held[-1]] = False
    sizes = np.array([len(c) for c in held])
    column, row = np.concatenate(held), np.repeat(np.arange(len(texts)), sizes)
    n = model.starts[column + 1] - model.starts[column]
    place = np.arange(n.sum()) + np.repeat(model.starts[column] - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.zeros(0, np.int64)
    width = len(model.sizes)
    both = np.bincount(np.repeat(row * width, n) + model.marks[place], minlength=len(texts) * width).reshape(len(texts), width)
    return both / np.sqrt(np.maximum(sizes[:, None], 1.0) * model.sizes[None, :]), letter


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows; landmarks are each language's first ones."""
    number = Counter(x for x, _ in rows)
    languages = tuple(sorted(number))
    if not languages:
        return Model((), *(np.zeros(0, np.int64),) * 4, np.zeros((0, 0)))
    most = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    seen: Counter = Counter()
    own = []
    for lang, text in sorted(rows, key=lambda r: r[0]):
        if seen[lang] < most:
            seen[lang] += 1
            own.append(grams(text))
    code, mark = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(code, kind="stable")
    distinct, n = np.unique(code, return_counts=True)
    model = Model(languages, distinct, np.r_[0, np.cumsum(n)], mark[order], np.array([len(x) for x in own]), np.zeros((0, 0)))
    k_nm = np.concatenate([kernel([t for _, t in rows[at : at + ROWS]], model)[0] for at in range(0, len(rows), ROWS)])
    k_mm = np.zeros((len(own), len(own)))
    for k, x in enumerate(own):
        place = np.searchsorted(distinct, x)
        held = np.concatenate([model.marks[model.starts[p] : model.starts[p + 1]] for p in place])
        k_mm[k] = np.bincount(held, minlength=len(own)) / np.sqrt(len(x) * model.sizes)
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x, _ in rows])
    # Languages weigh the same, however many texts each has.
    weight = np.array([1.0 / number[x] for x, _ in rows])[:, None]
    left = k_nm.T @ (weight * k_nm) + RIDGE * (k_mm + 1e-6 * np.eye(len(own)))
    return Model(languages, distinct, model.starts, model.marks, model.sizes, np.linalg.lstsq(left, k_nm.T @ (weight * y), rcond=None)[0])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model from the labelled rows of ``docs`` that have a letter: of each language TEXTS at most, chosen by a hash of id and text.

    Every language that labels a row is learned, whatever the length of its texts: of a text longer than
    PIECE characters a piece of that length is looked at, whose place depends on the hash. Repeated rows
    count once. The driver gets two hashes and a piece for each chosen row.
    """
    h = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_or_empty(text))
    known = docs.select(F.col(lang).cast("string").alias("_lang"), h.alias("_h"), text_or_empty(text).alias("_text")).where("_lang IS NOT NULL AND _text RLIKE '\\\\p{L}'")
    lowest: dict[str, list[int]] = {}
    for r in known.groupBy("_lang", F.pmod("_h", F.lit(TEXTS)).alias("_b")).agg(F.min("_h").alias("_h")).collect():
        lowest.setdefault(r._lang, []).append(r._h)
    if not lowest:
        return fit([])
    most = max(1, min(TEXTS, MOST_TEXTS // len(lowest)))
    chosen = {(x, h) for x, hs in lowest.items() for h in sorted(hs)[:most]}
    start = F.pmod(F.xxhash64("_h"), F.greatest(F.char_length("_text") - PIECE, F.lit(0)) + 1) + 1
    pieces = known.where(F.col("_h").isin([h for _, h in chosen])).groupBy("_lang", "_h").agg(F.min(F.substr("_text", start.cast("int"), F.lit(PIECE))).alias("_piece")).collect()
    rows = sorted((r._lang, r._h, r._piece) for r in pieces if (r._lang, r._h) in chosen)
    return fit([(x, t) for x, _, t in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score.

    ``und`` with score 0 for a null text, one without letters, and for all if the model knows no
    language. Only the text is looked at, all of it. Rows are scored one by one, so repeated rows agree.
    Columns that clash with the results are replaced, those that begin with an underscore dropped. An
    empty table gives an empty result.
    """
    docs = without_reserved(docs).drop("lang_pred", "score").withColumn("_text", text_or_empty(text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields if f.name != "_text"]
    ddl = ", ".join(f"`{n}` {t}" for n, t in [*fields, ("lang_pred", "string"), ("score", "double")])

    def score(batches):
        model = shared.value
        for part in slices(batches, "_text", BYTES):
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                texts = some.column("_text").to_pylist()
                if model.languages:
                    k, letter = kernel(texts, model)
                    values = k @ model.weights
                    odds = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
                    best = values.argmax(1)
                    points = odds[np.arange(len(best)), best] / odds.sum(1)
                    found = [(model.languages[b], float(p)) if ok else (UNDETERMINED, 0.0) for b, p, ok in zip(best, points, letter)]
                else:
                    found = [(UNDETERMINED, 0.0)] * len(texts)
                columns = [c for n, c in zip(some.schema.names, some.columns) if n != "_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=[n for n, _ in fields] + ["lang_pred", "score"])

    return docs.transform(mapped, score, ddl)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
