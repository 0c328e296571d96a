"""Perplexities by a small dense model: characters folded to `SYMBOLS` classes, four at a time, in one table that tasks look up.

`op4_quality` doesn't use it (see `ngrams.py`): it tells no letters beyond Latin apart and stays as large as it is whatever
it learns from. It serves short alphabets whose table is to be looked up where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut

ORDER, SYMBOLS = 4, 40
_SPACE, _DIGIT, _STOP, _SIGN, _OTHER, _EDGE = 0, 27, 36, 37, 38, 39
_CLASS = np.full(0x250, _OTHER, np.uint8)
for _c in range(0x250):
    _x = chr(_c).lower()[0]
    if _x.isspace():
        _CLASS[_c] = _SPACE
    elif "a" <= _x <= "z":
        _CLASS[_c] = 1 + ord(_x) - ord("a")
    elif _x.isdigit():
        _CLASS[_c] = _DIGIT
    elif _x.isalpha():
        _CLASS[_c] = 28 + ord(_x) % 8  # letters beyond a-z share eight classes
    elif _x in ".,;:!?'\"()-":
        _CLASS[_c] = _STOP
    elif _c < 128:
        _CLASS[_c] = _SIGN


def ngram_codes(text: str | None) -> np.ndarray:
    """Every character's n-gram as a number in base SYMBOLS; runs of white space are one blank. Empty for a blank text."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], _OTHER).astype(np.int64)
    x = x[(x != _SPACE) | (np.r_[_EDGE, x[:-1]] != _SPACE)]
    if not (x != _SPACE).any():
        return np.empty(0, np.int64)
    x = np.r_[np.full(ORDER - 1, _EDGE), x]
    n = len(x) - ORDER + 1
    return sum(x[i : i + n] * SYMBOLS ** (ORDER - 1 - i) for i in range(ORDER))


def count(texts: DataFrame) -> DataFrame:
    """code, c: how often each n-gram occurs in texts (text). Every task folds what it read first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                codes, n = np.unique(ngram_codes(t), return_counts=True)
                total[codes] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "c"])

    return texts.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def smoothed(counts: DataFrame) -> np.ndarray:
    """Log2 of the probability of every n-gram's last character after the others."""
    p = np.full(1, 1 / SYMBOLS)
    tables = [cut(counts)]
    for k in range(ORDER - 1, 0, -1):  # below the highest order, in how many contexts an n-gram occurs
        tables.append(cut(tables[-1].groupBy((F.col("code") % SYMBOLS**k).alias("code")).agg(F.count(F.lit(1)).alias("c"))))
    for k, table in enumerate(reversed(tables), 1):
        once = table.groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        n = {r["c"]: r["n"] for r in once}
        y = n.get(1, 0) / max(1, n.get(1, 0) + 2 * n.get(2, 0))
        cuts = [min(max(i - (i + 1) * y * n.get(i + 1, 0) / n[i], 0.1 * i), float(i)) if n.get(i) else 0.5 * i for i in (1, 2, 3)]
        discount = F.element_at(F.array(*[F.lit(float(d)) for d in cuts]), F.least("c", F.lit(3)).cast("int"))
        cut_off = table.select("code", "c", F.expr(f"code div {SYMBOLS}").alias("context"), discount.alias("discount"))
        contexts = cut_off.groupBy("context").agg(F.sum("c").alias("total"), F.sum("discount").alias("held_back"))
        rows = cut_off.join(contexts, "context").select("code", ((F.col("c") - F.col("discount")) / F.col("total")).alias("own"))
        own, rest = np.zeros(SYMBOLS**k), np.ones(SYMBOLS ** (k - 1))
        got = rows.toPandas()
        own[got["code"].to_numpy()] = got["own"].to_numpy()
        got = contexts.select("context", (F.col("held_back") / F.col("total")).alias("rest")).toPandas()
        rest[got["context"].to_numpy()] = got["rest"].to_numpy()
        # The lower order's n-gram is this one without its first character.
        p = own + np.repeat(rest, SYMBOLS) * (np.tile(p, SYMBOLS) if k > 1 else p)
    return np.log2(p).astype(np.float32)


def perplexities(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, lang, perplexity for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(table)  # SYMBOLS**ORDER numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log2 = sent.value
        for batch in batches:
            codes = [ngram_codes(t) for t in batch.column(2).to_pylist()]
            out = [round(float(2 ** -log2[c].mean(dtype=np.float64)), 6) if len(c) else None for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "lang", "perplexity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, lang string, perplexity double")
