"""SimHash near-duplicates: every pair of fingerprints within three bits, by meet-in-the-middle ball hashing.

Half of a radius of 3 is 1.5, and balls of radius 2 would cost 2,081 variants a fingerprint. So the 64 bits are cut into
three blocks of 22, 21 and 21 bits, and a projection leaves one block out. Of three differing bits, either one block has
at least two, and the projection without it differs in at most one bit; or each block has one, and the projection without
the first differs in two. Radius 2 on that projection is met in the middle: all fingerprints emit the ball of radius 1
around it. Radius 1 on the other two is met by the projection itself from all fingerprints and its ball from those whose
projection has an odd number of bits. That is 88 variants a fingerprint on average, and no pair within 3 bits is lost.

Variants are shuffled and sorted; the tasks verify what collides and pass on a spanning forest of the links found, never
the pairs of a bucket. Buckets of many members are searched by block values, in time linear in their size. Equal
fingerprints are folded into one before all this.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; rows that repeat a
doc_id each get a row; an empty table gives an empty result. doc_id must be an integer and not null; only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut, parallelism
from partloom.llm.components import components

RADIUS = 3
SEED = 42
#: First bit and width of the block that each projection leaves out.
BLOCKS = ((0, 22), (22, 21), (43, 21))
_ALL = (1 << 64) - 1
_STEP = 1 << 18  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's shingles; unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = words[at : min(at + _STEP, n) + shingle - 1]
        runs = zip(*[part[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(distinct: DataFrame) -> DataFrame:
    """key, fp: the variants that each fingerprint emits. A key has the projection's number in the block left out."""
    ways = []
    for n, (low, width) in enumerate(BLOCKS):
        keep = _ALL ^ (((1 << width) - 1) << low)
        ways.append((keep, n << low, False))
        ways += [(keep, (n << low) | (1 << b), n > 0) for b in range(64) if keep >> b & 1]
    rows = F.array(*[F.struct(F.lit(_signed(keep)).alias("keep"), F.lit(_signed(flip)).alias("flip"), F.lit(odd).alias("odd")) for keep, flip, odd in ways])
    each = distinct.select("fp", F.inline(rows))
    rest = F.col("fp").bitwiseAND(F.col("keep"))
    return each.where(~F.col("odd") | (F.bit_count(rest) % 2 == 1)).select(rest.bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _near_in_bucket(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints (uint64, distinct) of a bucket as all its pairs within RADIUS would."""
    if len(fps) <= 1500:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS, 1))
        return fps[a], fps[b]
    found = [_near_in_projection(np.uint64(key), fps, low, width) for n, (low, width) in enumerate(BLOCKS) if key >> low & ((1 << width) - 1) == n]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _near_in_projection(key: np.uint64, fps: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among those that lie within one bit of the key outside the block left out, by values of that block."""
    block = np.uint64(((1 << width) - 1) << low)
    rest = key & ~block
    fps = fps[np.bitwise_count((fps & ~block) ^ rest) <= 1]
    value = fps & block
    order = np.argsort(value, kind="stable")
    fps, value = fps[order], value[order]
    same = value[:-1] == value[1:]
    found = [(fps[:-1][same], fps[1:][same])]  # at most 2 bits, in the rest
    values, first = np.unique(value, return_index=True)
    inner = np.unique(fps[(fps & ~block) == rest] & block)
    bits = [np.uint64(1 << (low + i)) for i in range(width)]
    of = lambda v: fps[first[np.searchsorted(values, v)]]

    def look(left: np.ndarray, by: np.uint64, among: np.ndarray) -> None:
        if not len(left) or not len(among):
            return
        want = left ^ by
        hit = among[np.minimum(np.searchsorted(among, want), len(among) - 1)] == want
        found.append((of(left[hit]), of(want[hit])))

    for i, x in enumerate(bits):
        look(values, x, values)  # 1 bit here and at most 2 in the rest
        for j, y in enumerate(bits[:i]):
            look(inner, x | y, values)  # 2 here, at most 1 in the rest from the centre
            for z in bits[:j]:
                look(inner, x | y | z, inner)  # 3 here, both in the centre
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        for x, y in pairs.tolist():
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and fp; a bucket may go on in the next batch."""
    forest = _Forest()
    keys = fps = np.empty(0, np.uint64)

    def close(keys: np.ndarray, fps: np.ndarray) -> None:
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[start, len(keys)])
        two = start[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        forest.link(a[near], b[near])
        for s, n in zip(start[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            forest.link(*_near_in_bucket(int(keys[s]), fps[s : s + n]))

    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy().view(np.uint64)]
        fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
        if not len(keys):
            continue
        last = int(np.flatnonzero(keys == keys[-1])[0])  # equal keys are adjacent
        close(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
    close(keys, fps)
    links = [(x, forest.root(x)) for x in list(forest.up)]
    links = np.array([p for p in links if p[0] != p[1]], np.uint64).reshape(-1, 2).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id linked to it through any chain, itself included)."""
    spark = docs.sparkSession
    of_doc = cut(fingerprints(docs, shingle))
    distinct = cut(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    variants = _variants(distinct).repartition(parallelism(spark), "key").sortWithinPartitions("key", "fp")
    links = cut(variants.mapInArrow(_links, "a long, b long").distinct())
    # From here on a fingerprint goes by the least doc_id that has it, so that roots are component ids.
    ids = lambda c: distinct.select(F.col("fp").alias(c), F.col("least_id").alias(f"{c}_id"))
    links = links.join(ids("a"), "a").join(ids("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    roots = components(links)
    grouped = distinct.join(roots, F.col("least_id") == F.col("node"), "left").select("fp", F.coalesce("root", "least_id").alias("component_id"))
    return of_doc.join(grouped, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_of_each_group(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the least of its near-duplicate group."""
    heads = near_groups(docs, shingle).where("doc_id = component_id").select(F.col("doc_id").alias("head_id"))
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    kept = given.join(heads, F.col(named["doc_id"]) == F.col("head_id"), "left_semi")
    return kept.select(*[F.col(n).alias(c) for c, n in named.items()])
