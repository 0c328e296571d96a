"""Align the tokens of two vocabularies over the same bytes.

Both tokenizers cut a text's bytes; the byte offsets at which tokens of both end cut the tokens into groups. The offsets
are found by galloping intersection: the shorter of a document's two lists of ends goes through the longer by exponential,
then binary search, from a lower bound that a search of every 32nd end has set. Where an end is found, it is common and
slices the groups; the difference of the ranks of a token's first and last byte is the range of the other side's tokens
that it overlaps, which are its links. All of this is arrays over a batch of documents.

An id pair counts in how many documents it is linked. Rows of (document, pair) are never shuffled: each task gathers its
documents into slices of bounded size, keeps each document's pairs next to it as one short array, and sends each pair of
a slice once, with its number of documents there. The sums go back to the slices that hold the pair, and a slice's
documents look their pairs up. So what moves is the documents' arrays, once, and the pairs of each slice.

Defined results: a null or empty text, or one whose tokens of either side don't join to the text's bytes (a vocabulary that
normalizes, or U+2581 itself), has no tokens: zeros and an empty digest. Texts of any length are aligned whole. Repeated
rows are documents each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut, text_or_empty

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned together, and in a slice.
TOGETHER, SLICE = 1 << 20, 24 << 20
STRIDE = 32
_loaded: dict[tuple[str, str], Sides] = {}
_NONE = np.empty(0, np.int64)


class _Bytes:
    """A byte-level .json vocabulary. Its ids stand in the order of its merges, so they are the ranks that the merging tool wants."""

    def __init__(self, name: str) -> None:
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            told = json.load(f)
        if told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{name} isn't a plain byte-level vocabulary")
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        made = [vocab["".join(p) if isinstance(p, list) else p.replace(" ", "")] for p in merges]
        if any(a >= b for a, b in itertools.pairwise(made)):
            raise ValueError(f"{name} has ids in another order than its merges")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = dict(zip(map(chr, [*plain, *range(256, 512)]), [*plain, *(b for b in range(256) if b not in plain)], strict=False))
        special = {t["content"] for t in told["added_tokens"]}
        of = {i: bytes(map(byte_of.__getitem__, sign)) for sign, i in vocab.items() if sign not in special}
        self.bytes = [of.get(i, b"") for i in range(max(vocab.values()) + 1)]
        self.tool = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in of.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.tool.encode_ordinary(f" {t}") for t in texts]


class _Pieces:
    """A sentencepiece vocabulary, which puts a space before the text itself."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        piece = self.tool.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.tool.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.tool.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tool.encode(texts, num_threads=1)


def ranks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of y are below each of x, both in order: exponential, then binary search from a known lower bound."""
    if not len(x):
        return _NONE
    low = np.repeat(ranks(x[::STRIDE], y), STRIDE)[: len(x)] if len(x) > STRIDE else np.zeros(len(x), np.int64)
    n, high = len(y), np.empty(len(x), np.int64)
    end = np.r_[y, np.iinfo(np.int64).max]  # nothing is above the last
    going, step = np.arange(len(x)), 1
    while len(going):
        probe = np.minimum(low[going] + (step - 1), n)
        below = end[probe] < x[going]
        high[going[~below]] = probe[~below]
        going = going[below]
        low[going] = probe[below] + 1
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) >> 1
        below = y[middle] < x[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def overlaps(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y: ends of two cuts of the same bytes, x the one with fewer. For each token of x the first and the last token of y
    that it overlaps, and whether it ends where one of y does."""
    last = ranks(x, y)
    common = y[last] == x
    first = np.r_[np.zeros(min(1, len(x)), np.int64), (last + common)[:-1]]
    return first, last, common


class Sides:
    """Two vocabularies, and the alignment of documents' tokens."""

    def __init__(self, left: str, right: str) -> None:
        side = lambda name: (_Bytes if name.endswith(".json") else _Pieces)(name)
        self.of = (side(left), side(right))
        if isinstance(self.of[0], _Pieces) == isinstance(self.of[1], _Pieces):
            raise ValueError("one vocabulary is to be byte-level, the other of pieces")
        self.length = tuple(np.array(list(map(len, s.bytes)), np.int64) for s in self.of)
        self.width = len(self.of[1].bytes)  # a pair's code is left * width + right
        self.code = np.dtype("<u4" if len(self.of[0].bytes) * self.width < 1 << 32 else "<u8")
        most = max(len(s.bytes) for s in self.of)
        digits = len(str(most))
        self.text = np.array([str(i).encode() for i in range(most)], f"S{digits}").view(np.uint8).reshape(most, digits)

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both sides of each text, or none where either doesn't join to a space and the text."""
        found = []
        for text, a, b in zip(texts, *(s.encode(texts) for s in self.of), strict=True):
            whole = b" " + text.encode()
            fits = text and all(b"".join(map(s.bytes.__getitem__, ids)) == whole for s, ids in zip(self.of, (a, b), strict=True))
            found.append((a, b) if fits else ([], []))
        return found

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text: n (tokens of both sides), n_groups, n_links, digest; for each of its distinct linked pairs, text after
        text: doc, code and how often it is linked."""
        both = self.tokens(texts)
        n = np.array([[len(a), len(b)] for a, b in both], np.int64).reshape(-1, 2)
        ids = [np.fromiter(itertools.chain.from_iterable(t[i] for t in both), np.int64, n[:, i].sum()) for i in (0, 1)]
        docs = [np.repeat(np.arange(len(texts)), n[:, i]) for i in (0, 1)]
        # Offsets run on from text to text, and a text's last end is common, so no group or link spans two texts.
        ends = [np.cumsum(self.length[i][ids[i]]) for i in (0, 1)]
        common = [np.zeros(len(e), bool) for e in ends]
        doc, code = [], []
        shorter = np.where(n[:, 0] <= n[:, 1], 0, 1)
        for s in (0, 1):
            mine = [np.flatnonzero(shorter[d] == s) for d in docs]
            x, y = mine[s], mine[1 - s]
            first, last, same = overlaps(ends[s][x], ends[1 - s][y])
            common[s][x[same]] = True
            common[1 - s][y[last[same]]] = True
            many = last - first + 1
            # Tokens of the longer side from the first to the last, for each of the shorter side.
            of_y = y[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            of_x = np.repeat(x, many)
            a, b = (of_x, of_y) if s == 0 else (of_y, of_x)
            doc.append(docs[0][a])
            code.append(ids[0][a] * self.width + ids[1][b])
        doc, code = np.concatenate(doc), np.concatenate(code)
        n_links = np.bincount(doc, minlength=len(texts))
        if self.code.itemsize == 4:
            key = np.sort((doc << 32) | code)
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else _NONE
            doc, code, times = key[at] >> 32, key[at] & 0xFFFFFFFF, np.diff(np.r_[at, len(key)])
        else:
            order = np.lexsort((code, doc))
            doc, code = doc[order], code[order]
            at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else _NONE
            doc, code, times = doc[at], code[at], np.diff(np.r_[at, len(order)])
        digests = self._digests(ids, docs, common, len(texts))
        return {"n": n, "n_groups": np.bincount(docs[0][common[0]], minlength=len(texts)), "n_links": n_links, "digest": digests, "doc": doc, "code": code, "times": times}

    def _digests(self, ids: list[np.ndarray], docs: list[np.ndarray], common: list[np.ndarray], n: int) -> list[str]:
        """SHA-256 of each text's groups, written `a1,a2|b1;a3|b2,b3`."""
        closes = [np.flatnonzero(c) for c in common]  # the last token of each group, by side
        group = [np.cumsum(c) - c for c in common]
        place = (np.arange(len(ids[0])) + np.r_[0, closes[1] + 1][group[0]], np.arange(len(ids[1])) + (closes[0] + 1)[group[1]])
        total = len(ids[0]) + len(ids[1])
        row, sign, doc = np.empty(total, np.int64), np.full(total, ord(","), np.uint8), np.empty(total, np.int64)
        for p, i, d in zip(place, ids, docs, strict=True):
            row[p], doc[p] = i, d
        sign[place[0][closes[0]]] = ord("|")
        sign[place[1][closes[1]]] = ord(";")
        final = np.flatnonzero(doc[1:] != doc[:-1]) if total else _NONE
        sign[np.r_[final, total - 1] if total else _NONE] = 0
        signs = np.column_stack([self.text[row], sign])
        used = signs != 0
        size = np.bincount(doc, used.sum(axis=1), n).astype(np.int64)
        data = signs[used].tobytes()
        ends = np.cumsum(size)
        return [hashlib.sha256(data[e - s : e]).hexdigest() if s else "" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def sides(left: str = LEFT, right: str = RIGHT) -> Sides:
    if (left, right) not in _loaded:
        _loaded[left, right] = Sides(left, right)
    return _loaded[left, right]


_HELD = pa.struct([("pair", pa.int64()), ("n", pa.int64())])
_SLICED = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, held array<struct<pair:long,n:long>>"


def _held(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, and how many documents hold it; codes has a document's pairs once."""
    x = np.sort(np.concatenate(codes)) if codes else _NONE
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else _NONE
    return x[at], np.diff(np.r_[at, len(x)])


def sliced(docs: DataFrame, left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """A row for each document, with its pairs, and a row for each slice, with each of its pairs and the number of its documents (held)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, seen, size = sides(left, right), [], 0
        number = TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            pair, n = _held(seen)
            held = pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), pa.StructArray.from_arrays([pa.array(pair), pa.array(n)], fields=list(_HELD)))
            nulls = lambda t: pa.nulls(1, t)
            return pa.RecordBatch.from_arrays([pa.array([number]), *[nulls(pa.int64()) for _ in range(5)], nulls(pa.string()), nulls(pa.binary()), nulls(pa.binary()), held], names=_NAMES)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            bytes_of = np.cumsum([len(t) for t in texts])
            starts = [0, *(np.flatnonzero(np.diff(bytes_of // TOGETHER)) + 1).tolist()] if texts else []
            for lo, hi in itertools.pairwise([*starts, len(texts)]):
                got = tool.align(texts[lo:hi])
                ends = np.cumsum(np.bincount(got["doc"], minlength=hi - lo))
                cut_by = lambda data, width, ends=ends: [data[s * width : e * width] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                pairs = cut_by(got["code"].astype(tool.code).tobytes(), tool.code.itemsize)
                times = cut_by(got["times"].astype("<u4").tobytes(), 4)
                columns = [np.full(hi - lo, number), None, got["n"][:, 0], got["n"][:, 1], got["n_groups"], got["n_links"]]
                columns = [pa.array(c, pa.int64()) if c is not None else batch.column(0).slice(lo, hi - lo) for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got["digest"], pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary()), pa.nulls(hi - lo, pa.list_(_HELD))], names=_NAMES)
                seen.append(got["code"])
                size += sum(map(len, texts[lo:hi]))
                if size >= SLICE:
                    yield closed()
                    seen, size, number = [], 0, number + 1
        if seen:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _SLICED)


_NAMES = [c.split()[0] for c in _SLICED.replace("array<struct<pair:long,n:long>>", "array").split(", ")]
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs."""
    rows = cut(sliced(docs, left, right))
    held = rows.where("held is not null").select("slice", F.inline("held"))
    counts = cut(held.groupBy("pair").agg(F.sum("n").alias("n")))
    width = len(sides(left, right).of[1].bytes)
    a = F.expr(f"int(pair div {width})")
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most a row for each id of the left vocabulary
    known = counts.join(F.broadcast(best), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    looked_up = held.select(F.col("slice").alias("of"), "pair").join(known, "pair").select("of", "pair", "n", "best")

    def score(of_slice: pa.Table, pairs: pa.Table) -> pa.Table:
        key = pairs.column("pair").to_numpy()
        order = np.argsort(key)
        key, n, top = key[order], pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
        binary = of_slice.column("pairs").to_pylist()
        times = np.frombuffer(b"".join(of_slice.column("times").to_pylist()), "<u4").astype(np.int64)
        code = np.frombuffer(b"".join(binary), sides(left, right).code).astype(np.int64)
        ends = np.cumsum([len(b) for b in binary], dtype=np.int64) // sides(left, right).code.itemsize
        at = np.searchsorted(key, code)
        per_row = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
        best, total = (per_row(times * top[at]), per_row(times * n[at])) if len(key) else (np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64))
        out = {c: of_slice.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(out | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": of_slice.column("groups_sha256")})

    of_docs = rows.where("held is null").drop("held")
    return of_docs.groupBy("slice").cogroup(looked_up.groupBy("of")).applyInArrow(score, _OUT)
