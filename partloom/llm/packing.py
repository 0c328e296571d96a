"""Pack documents into training sequences next to the documents they share words with.

Documents are tokenized once. Shards of about `SHARD` ids build an inverted index with BM25 weights; document frequencies
and the mean length are those of the whole table. Shards are dealt by content: a document goes by one of its terms, drawn
by weight with the same luck for all documents, so that the more two have in common the likelier they meet. Only a term
that holds more than a part of a shard is split by a hash. In a shard, the first unused document is the seed of a window;
the index returns the unused documents nearest to it by all its terms, which fill the window one after the other.
The one that doesn't fit is cut, and its rest is the next window's seed. Windows are full but for a shard's last, whose
ids go into sequences of powers of two, so nothing is padded.

Defined results: a null text is empty; an empty document is its end mark alone; rows that repeat are packed each; texts of
any length are read whole and span windows; equal scores go to the smaller doc_id; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut, text_or_empty

WINDOW, END = 4096, 2
#: Ids in a shard, about; words that a task remembers the ids of.
SHARD, REMEMBERED = 3_000_000, 300_000
K1, B = 1.2, 0.75
#: Neighbours that a seed gets at a time, and ties; if a window takes them all, it asks for more.
NEAREST = 48
#: A term's documents are split if they hold more than this part of a shard.
PART = 8
#: A term has a row of its own in a shard's index if more than one document in so many holds it.
COMMON = 8
_LUCK = -np.log1p(-np.random.default_rng(42).random(1 << 16))
_MARK = "\x01"
# Lower-case words of these letters, ASCII digits and signs fall apart by this pattern as by the tokenizer's own.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_SIMPLE = re.compile(r"[!-@\[-`a-z{-~ß-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_loaded: dict[str, _Words] = {}


class _Words:
    """A tokenizer that remembers the ids of words.

    No token of it spans white space, so a text's ids are those of its words. Plain words not met before go through its
    merges in one call for many: each word ends in a mark that stands for the vocabulary's end-of-word sign.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(public_tokenizers.path(name))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = [*plain, *range(256, 512)]
        byte_of = {chr(c): b for c, b in zip(signs, [*plain, *(b for b in range(256) if b not in plain)], strict=False)}
        ranks = {}
        self.last = np.zeros(1 << 16, bool)  # whether an id ends a word
        special = set(self.tool.get_added_tokens_decoder())
        for sign, i in self.tool.get_vocab().items():
            if i not in special:
                self.last[i] = sign.endswith("</w>")
                ranks[bytes(byte_of[c] for c in sign.removesuffix("</w>")) + _MARK.encode() * bool(self.last[i])] = i
        self.merges = tiktoken.Encoding(name, pat_str=rf"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.start = np.empty(0, np.uint16), np.zeros(1, np.int64)  # word n has ids[start[n]:start[n + 1]]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self) -> None:
        """Ids of the words that got a number since the last time."""
        new, self.number.new = self.number.new, []
        parts = [(w,) if _LETTERS.fullmatch(w) else _PARTS.findall(w) if _SIMPLE.fullmatch(w) else None for w in new]
        ids = np.array(self.merges.encode_ordinary("".join([p + _MARK for x in parts if x for p in x])), np.uint16)
        sizes = np.array([len(x) if x else 0 for x in parts], np.int64)
        ends = np.r_[0, np.flatnonzero(self.last[ids]) + 1][np.cumsum(sizes)]
        lengths = np.diff(ends, prepend=0)
        other = [i for i, x in enumerate(parts) if not x]
        if other:
            found = self.whole([new[i] for i in other])
            ids = np.insert(ids, np.repeat(ends[other], [len(x) for x in found]), np.concatenate(found))
            lengths[other] = [len(x) for x in found]
        self.ids = np.r_[self.ids, ids]
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(lengths)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            part = texts[at : at + 512]
            if len(self.number) > REMEMBERED:
                self.forget()
            split = [t.lower().split() if _plain(t) else None for t in part]
            odd = iter(self.whole([t for t, words in zip(part, split, strict=True) if words is None]))
            numbers = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) if words else _NONE for words in split]
            if self.number.new:
                self.learn()
            for words, n in zip(split, numbers, strict=True):
                if words is None:
                    out.append(next(odd).tobytes())
                    continue
                first, size = self.start[n], self.start[n + 1] - self.start[n]
                ends = np.cumsum(size)
                out.append(self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return out


class _Numbers(dict):
    """Words to numbers; a word not met before gets the next one and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


_NONE = np.empty(0, np.int64)


def _plain(text: str) -> bool:
    """Whether lower-casing and splitting it in Python gives what the tokenizer's normalizer would."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", _MARK, "<|"))


def encode_batch(texts: list[str], name: str) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 16-bit numbers."""
    if name not in _loaded:
        _loaded[name] = _Words(name)
    return _loaded[name].encode(texts)


def _counted(docs: list[np.ndarray], low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document in turn its distinct ids in order: the document's number from low on, the id, how often it occurs."""
    if not docs:
        return _NONE, _NONE, _NONE
    x = np.sort((np.repeat(np.arange(low, low + len(docs)), [len(d) for d in docs]) << 16) | np.concatenate(docs))
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    n = np.diff(at, append=len(x))
    x = x[at]
    return x >> 16, x & 0xFFFF, n


def _parts(docs: list, size: int = 256) -> Iterator[tuple[int, list]]:
    return ((low, docs[low : low + size]) for low in range(0, len(docs), size))


def tokenized(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, ids (with the end mark), their number n, and in one row of each task the number of its documents that hold each id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 16, np.int64)
        for batch in batches:
            end = np.array([END], "<u2").tobytes()
            ids = [x + end for x in encode_batch(batch.column(1).to_pylist(), name)]
            for _, part in _parts(ids):
                held += np.bincount(_counted([np.frombuffer(x, "<u2") for x in part])[1], minlength=len(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.nulls(len(ids), _HELD)], names=["doc_id", "ids", "n", "held"])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([[{"id": a, "n": b} for a, b in zip(some.tolist(), held[some].tolist(), strict=True)]], _HELD)], names=["doc_id", "ids", "n", "held"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary, n long, held array<struct<id:int,n:long>>")


_HELD = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))


def _keys(docs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """One of the terms of each document. Two documents get the same with a chance that grows with the weight they share."""
    owner, t, n = _counted(docs)
    w = idf[t] * (n * (K1 + 1) / (n + K1))
    w[t == END] = 0  # not a word
    luck = _LUCK[t] / np.maximum(w, 1e-12)
    if not docs:
        return _NONE
    first = np.searchsorted(owner, np.arange(len(docs)))
    best = np.flatnonzero(luck == np.minimum.reduceat(luck, first)[owner])
    return t[best[np.searchsorted(owner[best], np.arange(len(docs)))]]


class Index:
    """BM25 weights of the terms of a shard's documents, by term: a whole row for each term that many documents hold, a
    list of documents and weights for the others."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        found = []
        lengths = np.array([len(d) for d in docs], np.int64)
        for low, part in _parts(docs):
            owner, term, n = _counted(part, low)
            weight = idf[term] * (n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[owner] / mean)))
            word = term != END
            found.append((owner[word].astype(np.int32), term[word].astype(np.uint16), weight[word].astype(np.float32)))
        owner, term, weight = (np.concatenate([f[i] for f in found]) if found else _NONE for i in range(3))
        self.ask = np.split(term, np.searchsorted(owner, np.arange(1, len(docs))))
        self.n = len(docs)
        held = np.bincount(term, minlength=1 << 16)
        # Adding up a row costs about a tenth of what a list of as many documents costs. The rows take 32 bytes a list entry at most.
        self.row = np.full(1 << 16, -1, np.int64)
        common = np.flatnonzero(held * COMMON > self.n)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        in_row = self.row[term] >= 0
        self.rows[self.row[term[in_row]], owner[in_row]] = weight[in_row]
        term, owner, weight = term[~in_row], owner[~in_row], weight[~in_row]
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.alive = np.arange(self.n)  # the documents that the rows have columns for

    def forget(self, used: np.ndarray) -> None:
        """Leave out the documents used, once they are half of those listed."""
        keep = ~used[self.alive]
        if 2 * int(keep.sum()) > len(self.alive):
            return
        self.alive, self.rows = self.alive[keep], np.ascontiguousarray(self.rows[:, keep])
        keep = ~used[self.owner]
        self.start = np.r_[0, np.cumsum(keep)][self.start]
        self.owner, self.weight = self.owner[keep], self.weight[keep]

    def scores(self, seed: int) -> np.ndarray:
        ask, out = self.ask[seed], np.zeros(self.n, np.float32)
        rows = self.row[ask]
        some = np.zeros(len(self.alive), np.float32)
        for r in rows[rows >= 0].tolist():
            some += self.rows[r]
        out[self.alive] = some
        rare = ask[rows < 0].astype(np.int64)
        size = self.start[rare + 1] - self.start[rare]
        if size.any():
            ends = np.cumsum(size)
            at = np.repeat(self.start[rare] - ends + size, size) + np.arange(ends[-1])
            out += np.bincount(self.owner[at], self.weight[at], self.n).astype(np.float32)
        return out


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents of a shard."""
    out, sequence, offset = [], 0, 0
    index = Index(docs, idf, mean)
    used = np.zeros(len(docs), bool)
    queue: list[int] = []
    seed = -1  # the window's, if it may have more neighbours
    waiting = -1  # the last document's rest, where the next window begins
    done = 0
    at = 0
    while True:
        if waiting < 0:
            # Neighbours of the window's seed while it isn't full and has any, then a new seed: the first unused document.
            if not queue and seed >= 0:
                queue = _neighbours(index, seed, used)
            if queue:
                waiting = queue.pop()
            else:
                while at < len(docs) and used[at]:
                    at += 1
                if at == len(docs):
                    break
                seed = waiting = at
                queue = _neighbours(index, seed, used)
            used[waiting], done = True, 0
        take = min(len(docs[waiting]) - done, window - offset)
        out.append((waiting, done, take, sequence, offset))
        done, offset = done + take, offset + take
        full, ended = offset == window, done == len(docs[waiting])
        if full:
            sequence, offset = sequence + 1, 0
            # The document at the cut seeds the next window, unless it fills that one by itself.
            seed = waiting if not ended and len(docs[waiting]) - done < window else -1
            queue = _neighbours(index, seed, used) if seed >= 0 else []
        if ended:
            waiting = -1
    return _in_powers(out, sequence, offset)


def _neighbours(index: Index, seed: int, used: np.ndarray) -> list[int]:
    """Unused documents that share a term, the nearest last."""
    index.forget(used)
    score = index.scores(seed)
    score[used] = 0
    score[seed] = 0
    some = np.flatnonzero(score > 0)
    if len(some) > NEAREST:
        least = np.partition(score[some], -NEAREST)[-NEAREST]
        some = some[score[some] >= least]
    return some[np.lexsort((-some, score[some]))].tolist()


def _in_powers(pieces: list[tuple[int, int, int, int, int]], last: int, size: int) -> list[tuple[int, int, int, int, int]]:
    """The last sequence, if it isn't full, as sequences of powers of two, the largest first."""
    out = [p for p in pieces if p[3] != last or not size]
    tail = [p for p in pieces if p[3] == last and size]
    sequence, room, offset = last, 1 << (size.bit_length() - 1) if size else 0, 0
    for doc, start, length, _, _ in tail:
        while length:
            take = min(length, room - offset)
            out.append((doc, start, take, sequence, offset))
            start, length, offset, size = start + take, length - take, offset + take, size - take
            if offset == room:
                sequence, room, offset = sequence + 1, 1 << (size.bit_length() - 1) if size else 0, 0
    return out


def sequences(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    all_rows = cut(tokenized(docs, tokenizer))
    ids = all_rows.where(F.col("n").isNotNull()).select("doc_id", "ids")
    n_docs, n_ids = all_rows.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most as many rows as the vocabulary, whatever the table's size.
    held = all_rows.where(F.col("held").isNotNull()).select(F.inline("held")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(1 << 16)
    count[[r["id"] for r in held]] = [r["n"] for r in held]
    idf = np.log(1 + (n_docs - count + 0.5) / (count + 0.5))
    mean = n_ids / max(1, n_docs)
    shards = max(1, -(-n_ids // shard))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
            keys = np.concatenate([_NONE, *(_keys(part, idf) for _, part in _parts(docs))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int32())], names=["doc_id", "ids", "key"])

    if shards > 1:
        ids = ids.mapInArrow(keyed, "doc_id long, ids binary, key int")
        # By terms again, so at most as many rows as the vocabulary.
        parts = ids.groupBy("key").agg(F.ceil(F.sum(F.length("ids")) * PART / (2 * shard)).alias("parts"))
        part = F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.col("parts"))
        dealt = ids.join(F.broadcast(parts), "key").select("doc_id", "ids", "key", part.alias("part")).repartition(shards, "key", "part").drop("key", "part")
    else:
        dealt = ids.repartition(1, F.xxhash64("doc_id", F.crc32("ids")))
    dealt = dealt.withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        texts: list[np.ndarray] = []
        number = 0
        for batch in batches:
            names += batch.column(0).to_pylist()
            texts += [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
            number = batch.column(2)[0].as_py() if batch.num_rows else number
        found = pack(texts, idf, mean, window) if texts else []
        crc = [zlib.crc32(texts[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in found]
        column = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                column([names[p[0]] for p in found]), column([p[1] for p in found]), column([p[2] for p in found]), column(crc),
                column([len(texts[p[0]]) for p in found]), column([(number << 32) + p[3] for p in found]), column([p[4] for p in found]),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
