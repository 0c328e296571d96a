"""Perplexities by an interpolated modified Kneser-Ney model (Chen and Goodman 1999) of characters, `ORDER` at a time.

Characters are taken as they are; only a run of white space is one blank. The n-grams are strings in tables that grow with
what is read, counted, discounted and smoothed by groupings and joins. A slice of the documents (a partition, or several
small ones) sends each of its distinct n-grams once to the counts, which send its probability back to the slice. Texts
don't travel: the slices are zipped with what comes back, partition by partition.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut

ORDER = 5
#: Stands before a text. White space in texts is blanks only, so none has it.
EDGE = "\n"
#: What the lowest order leaves is shared by all characters of Unicode.
CHARACTERS = 0x110000 - 0x800
#: Partitions are put together to slices of so many characters; n-grams that partitions share are then sent once.
SLICE = 16_000_000
#: Characters that a task works on at a time, and numbers that it holds before it adds them up.
CHUNK, HELD = 250_000, 800_000
#: Documents a packed batch.
ROWS = 500


def _blob(rows: list[tuple]) -> bytes:
    return zlib.compress(pickle.dumps(rows, pickle.HIGHEST_PROTOCOL), 1)


def _rows(blob: bytes) -> list[tuple]:
    return pickle.loads(zlib.decompress(blob))


def _to_slices(df: DataFrame, n: int, *columns: Column) -> RDD:
    """Partition i: one list with a row (i, columns aggregated over what df has for slice i), or an empty one."""
    rows = df.repartitionById(n, "slice").groupBy("slice").agg(*columns).rdd
    if rows.getNumPartitions() != n:  # Spark drops the exchange of a table that it knows to be empty
        if not rows.isEmpty():
            raise ValueError(f"{rows.getNumPartitions()} partitions instead of {n}")
        rows = df.sparkSession.sparkContext.parallelize([], n)
    return rows.mapPartitions(lambda it: [[tuple(r) for r in it]])


def slices(docs: DataFrame) -> RDD:
    """Partition i: (i, its documents packed as doc_id, lang, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).rdd
    characters = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    most = max(1, -(-characters // SLICE))
    if rows.getNumPartitions() > most:
        rows = rows.coalesce(most)

    def pack(i: int, it: Iterator[tuple]) -> Iterator[tuple[int, list[bytes]]]:
        blobs = []
        while some := list(islice(it, ROWS)):
            blobs.append(_blob([tuple(r) for r in some]))
        yield i, blobs

    return rows.mapPartitionsWithIndex(pack)


def _windows(blobs: list[bytes]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Documents (doc_id, lang, number of n-grams), the code points of their texts with edges, and where an n-gram begins."""

    def one(rows: list[tuple]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        edge = EDGE * (ORDER - 1)
        points = np.frombuffer("".join(edge + t for _, _, t in rows).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for _, _, t in rows])
        starts = np.ones(len(points), bool)
        starts[(np.cumsum(size + ORDER - 1)[:, None] - 1 - np.arange(ORDER - 1)).ravel()] = False
        return [(i, lang, len(t)) for i, lang, t in rows], points, np.flatnonzero(starts)

    rows, held = [], 0
    for blob in blobs:
        for i, lang, text in _rows(blob):
            rows.append((i, lang, " ".join((text or "").split())))
            held += len(rows[-1][2])
            if held >= CHUNK:
                yield one(rows)
                rows, held = [], 0
    if rows:
        yield one(rows)


class Codes:
    """N-grams of a slice as 64-bit numbers: digits of its own characters, or, if those are too many, their first three by rank."""

    def __init__(self, texts: Iterable[str], arrays: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]) -> None:
        """texts: all characters; arrays: code points and where n-grams begin in them."""
        seen = np.zeros(0x110000, bool)
        seen[[ord(EDGE), ord(" ")]] = True
        for t in texts:
            seen[np.frombuffer(t.encode("utf-32-le"), np.uint32)] = True
        self.letters = np.flatnonzero(seen)
        self.base = max(1, len(self.letters))
        self.digit = np.zeros(0x110000, np.int64)
        self.digit[self.letters] = np.arange(len(self.letters))
        self.firsts = None
        if self.base**ORDER >= 2**63:
            firsts = np.empty(0, np.int64)
            for points, at in arrays():
                firsts = np.union1d(firsts, self._number(self.digit[points], at, 0, 3))
            self.firsts = firsts

    def _number(self, digits: np.ndarray, at: np.ndarray, start: int, stop: int) -> np.ndarray:
        out = digits[at + start]
        for i in range(start + 1, stop):
            out = out * self.base + digits[at + i]
        return out

    def of(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        digits = self.digit[points]
        if self.firsts is None:
            return self._number(digits, at, 0, ORDER)
        return np.searchsorted(self.firsts, self._number(digits, at, 0, 3)) * self.base ** (ORDER - 3) + self._number(digits, at, 3, ORDER)

    def texts(self, codes: np.ndarray) -> list[str]:
        points = np.empty((len(codes), ORDER), np.uint32)
        rest, last = codes // self.base ** (ORDER - 3), codes % self.base ** (ORDER - 3)
        rest = rest if self.firsts is None else self.firsts[rest]
        for i in range(ORDER - 1, -1, -1):
            if i >= 3:
                last, digit = np.divmod(last, self.base)
            else:
                rest, digit = np.divmod(rest, self.base)
            points[:, i] = self.letters[digit]
        joined = points.tobytes().decode("utf-32-le")
        return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]


def _summed(found: list[np.ndarray]) -> np.ndarray:
    """Codes and their numbers, each code once and in order."""
    codes, n = np.concatenate(found, axis=1)
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return np.stack([codes[first], np.add.reduceat(n, first) if len(first) else n])


def _counted(pair: tuple) -> Iterator[tuple]:
    """slice, grams, numbers of one slice, some at a time: every distinct n-gram and how often the documents to learn from have it."""
    (at_slice, blobs), flags = pair
    learned = np.array([i for r in flags for i in r[1]], np.int64)
    texts = (t for b in blobs for _, _, t in _rows(b) if t)
    code = Codes(texts, lambda: ((points, at) for _, points, at in _windows(blobs)))
    found, held = [np.empty((2, 0), np.int64)], 0
    for rows, points, at in _windows(blobs):
        x = code.of(points, at)
        ids = np.array([-1 if i is None else i for i, _, _ in rows], np.int64)
        fits = np.isin(ids, learned) & np.array([i is not None for i, _, _ in rows])
        taught, times = np.unique(x[np.repeat(fits, [m for _, _, m in rows])], return_counts=True)
        x = np.unique(x)
        found += [np.stack([x, np.zeros(len(x), np.int64)]), np.stack([taught, times])]
        held += len(x) + len(taught)
        if held > HELD:
            found, held = [_summed(found)], 0
    codes, n = _summed(found)
    for i in range(0, len(codes), 20_000):
        yield at_slice, code.texts(codes[i : i + 20_000]), n[i : i + 20_000].tolist()


def _answered(joined: str, log2: list[float]) -> tuple[Codes, np.ndarray, np.ndarray]:
    """The codes of n-grams that stand one behind the other, in order, and their numbers."""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = np.arange(0, len(points), ORDER)
    code = Codes([joined], lambda: [(points, at)])
    codes = code.of(points, at)
    order = np.argsort(codes)
    return code, codes[order], np.array(log2, np.float32)[order]


def _scored(pair: tuple) -> Iterator[tuple]:
    """doc_id, lang, perplexity of the documents of one slice."""
    (at_slice, blobs), answers = pair
    for back_at, joined, back in answers:
        if back_at != at_slice:
            raise ValueError("n-grams came back to another slice")
        code, codes, log2 = _answered(joined, back)
    answers.clear()
    for rows, points, at in _windows(blobs):
        sizes = np.array([m for _, _, m in rows])
        sums = np.r_[0.0, np.cumsum(log2[np.searchsorted(codes, code.of(points, at))], dtype=np.float64)] if len(at) else np.zeros(1)
        stops = np.cumsum(sizes)
        for (i, lang, m), total in zip(rows, sums[stops] - sums[stops - sizes], strict=True):
            yield i, lang, round(float(2 ** -(total / m)), 6) if m else None


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, p for every row of grams (gram, c), a table of distinct ones: the probability of its last character after the others, by the
    rows with c over 0; the others only ask."""
    orders = [grams]
    for k in range(ORDER - 1, 0, -1):  # below the highest order, in how many contexts an n-gram occurs
        orders.append(cut(orders[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c"))))
    below = None
    for k, table in enumerate(reversed(orders), 1):
        once = table.where("c > 0").groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        n = {r["c"]: r["n"] for r in once}
        y = n.get(1, 0) / max(1, n.get(1, 0) + 2 * n.get(2, 0))
        cuts = [min(max(i - (i + 1) * y * n.get(i + 1, 0) / n[i], 0.1 * i), float(i)) if n.get(i) else 0.5 * i for i in (1, 2, 3)]
        discount = F.element_at(F.array(*[F.lit(float(d)) for d in (0, *cuts)]), (F.least("c", F.lit(3)) + 1).cast("int"))
        rows = table.select("gram", "c", discount.alias("discount"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("lower"))
        contexts = rows.where("c > 0").groupBy("context").agg(F.sum("c").alias("total"), F.sum("discount").alias("held_back"))
        rows = rows.join(contexts, "context", "left")
        rows = rows.withColumn("below", F.lit(1 / CHARACTERS)) if below is None else rows.join(below.select(F.col("gram").alias("lower"), F.col("p").alias("below")), "lower")
        own, rest = (F.col("c") - F.col("discount")) / F.col("total"), F.col("held_back") / F.col("total")
        below = cut(rows.select("gram", (F.coalesce(own, F.lit(0.0)) + F.coalesce(rest, F.lit(1.0)) * F.col("below")).alias("p")))
    return below


def perplexities(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity for every row of docs, by the texts of those whose doc_id is in learned (distinct)."""
    spark, schema = docs.sparkSession, "doc_id long, lang string, perplexity double"
    parts = slices(docs)
    n = parts.getNumPartitions()
    if n == 0:
        return spark.createDataFrame([], schema)
    ids = parts.flatMap(lambda part: [(part[0], i) for b in part[1] for i, _, _ in _rows(b) if i is not None])
    flags = spark.createDataFrame(ids, "slice int, doc_id long", verifySchema=False).join(learned.hint("merge"), "doc_id", "left_semi")
    found = parts.zip(_to_slices(flags, n, F.collect_list("doc_id"))).flatMap(_counted)
    found = spark.createDataFrame(found, "slice int, gram array<string>, c array<long>", verifySchema=False)
    grams = found.select("slice", F.inline(F.arrays_zip("gram", "c")))
    asked = cut(grams.repartition("gram").groupBy("gram").agg(F.sum("c").alias("c"), F.collect_list("slice").alias("slices")))
    answers = asked.select("gram", "slices").join(probabilities(asked.select("gram", "c")), "gram").select(F.explode("slices").alias("slice"), "gram", F.log2("p").cast("float").alias("log2"))
    scored = parts.zip(_to_slices(answers, n, F.array_join(F.collect_list("gram"), ""), F.collect_list("log2"))).flatMap(_scored)
    return spark.createDataFrame(scored, schema, verifySchema=False)
