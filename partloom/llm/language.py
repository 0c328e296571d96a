"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its three letters' vectors, permuted
(rotated) by their place; a text's vector bundles (adds) its trigrams' vectors, and a language's prototype bundles the
directions of its texts. The language whose prototype has the largest cosine with the text is predicted.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text if there is nothing to learn
from; a null lang is never learned; equal cosines go to the smaller name; repeated rows each get a row; further columns
pass through, but lang_pred and score replace columns of those names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
LETTERS = 4093  # letters share vectors beyond so many
#: About so many texts at most are learned from, chosen by a hash of doc_id from all that may be.
MOST_LEARNED = 20_000
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
_LETTER_IN = regex.compile(r"\p{L}")
_rng = np.random.default_rng(20240229)
_LETTER = (_rng.integers(0, 2, (LETTERS + 1, DIMENSIONS), dtype=np.int8) * 2 - 1).astype(np.int8)
_PLACES = (np.roll(_LETTER, 2, axis=1), np.roll(_LETTER, 1, axis=1), _LETTER)
_known: dict[int, np.ndarray] = {}


def _trigram(code: int) -> np.ndarray:
    if (v := _known.get(code)) is None:
        if len(_known) > 20_000:
            _known.clear()
        a, b, c = code >> 24, code >> 12 & 4095, code & 4095
        v = _known[code] = _PLACES[0][a] * _PLACES[1][b] * _PLACES[2][c]
    return v


def _codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's trigrams and how often each occurs. Words are bounded by a blank, letter 0; no letters, no trigrams."""
    words = _NO_LETTER.sub(" ", text or "").strip().lower()
    if not _LETTER_IN.search(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x = np.where(points == 32, 0, 1 + points % LETTERS)
    return np.unique((x[:-2] << 24) | (x[1:-1] << 12) | x[2:], return_counts=True)


def encode(texts: list[str | None]) -> np.ndarray:
    """A row of length 1 for each text, zeros without letters. The sums are of whole numbers, so their order is free."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(texts), 64):
        found = [_codes(t) for t in texts[at : at + 64]]
        every = np.unique(np.concatenate([c for c, _ in found]))
        for low in range(0, len(every), 4096):
            some = every[low : low + 4096]
            counts = np.zeros((len(found), len(some)), np.float32)
            for row, (codes, n) in zip(counts, found, strict=True):
                here = slice(*np.searchsorted(codes, [some[0], some[-1] + 1]))
                row[np.searchsorted(some, codes[here])] = n[here]
            out[at : at + len(found)] += counts @ np.stack([_trigram(c) for c in some.tolist()]).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # a row of length 1 for each language


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, most: int = MOST_LEARNED) -> Prototypes:
    """Prototypes from doc_id, text and lang of the rows that aren't held out.

    Tasks add up vectors; the sums of each language meet in one shuffle. What reaches the driver is a vector a language.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 1024):
                for v, lang in zip(encode(texts[at : at + 1024]), langs[at : at + 1024], strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    sums = rows.select("text", "lang").mapInArrow(run, "lang string, sums array<double>")
    # Rounded so that the order in which tasks end changes nothing.
    total = sums.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    found = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("x")).orderBy("lang").collect()
    vectors = np.array([[y["x"] for y in r["x"]] for r in found], np.float64).reshape(-1, DIMENSIONS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Prototypes([r["lang"] for r in found], vectors.astype(np.float32))


def identify(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """docs with lang_pred and score (the largest cosine, not below 0), from text alone."""
    docs = docs.drop("lang_pred", "score")
    names, vectors = prototypes.languages, prototypes.vectors

    def guess(texts: list[str | None]) -> list[tuple[str, float]]:
        v = encode(texts)
        near = v @ vectors.T if names else np.zeros((len(texts), 1), np.float32)
        best = near.argmax(axis=1).tolist()
        known = v.any(axis=1) & bool(names)
        return [(names[b], min(1.0, max(0.0, round(float(near[i, b]), 5)))) if known[i] else ("und", 0.0) for i, b in enumerate(best)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = [g for at in range(0, len(texts), 1024) for g in guess(texts[at : at + 1024])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs whose language is recognised with more than the least score, with the columns of docs."""
    named = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    guessed = identify(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), learn(docs))
    return guessed.where((F.col("lang_pred") != "und") & (F.col("score") > least)).select(*[F.col(n).alias(c) for c, n in named.items()])
