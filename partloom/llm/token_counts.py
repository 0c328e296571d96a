"""Count the tokens of texts by merging ragged arrays in step.

A byte-pair vocabulary merges the neighbours of lowest rank first, one pre-token by itself. Here the pre-tokens of a batch
lie one after the other in one numpy array, and each round finds each sequence's lowest rank and merges all places of that
pair at once, in all sequences; ranks are looked up only where something changed, and finished sequences leave. A merged
symbol's own merges have higher ranks in any trained vocabulary (checked on loading), so merging all places of a pair
together gives what merging one after the other gives. The symbols that survive are the tokens. A sequence of more than
`LONG` symbols would take as many rounds as it has ranks, so it is merged rank by rank over linked arrays instead,
touching only what changes.

The tokenizer's own normalizer and pre-tokenizer cut texts into pre-tokens; counts of words are remembered within a task,
a bounded number of them. Special strings inside a text count as one token each, as is the library's default.

Defined results: a null or empty text has no tokens and no bytes; texts of any length are counted whole; repeated rows are
counted each; an empty table gives an empty result; only doc_id and text are read, further columns of any name are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import text_or_empty

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Words whose counts a task remembers; symbols of a sequence that is merged by itself; texts counted together.
REMEMBERED, LONG, TOGETHER = 200_000, 512, 256
_NEVER = np.int64(1) << 40
_loaded: dict[str, Counter] = {}


class Merges:
    """The merge table of a byte-pair vocabulary of fewer than 65,536 symbols, and the first symbols of its alphabet."""

    def __init__(self, model: dict) -> None:
        vocab, pairs = model["vocab"], [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int64)
        rank_of = np.full(1 << 16, -1, np.int64)
        rank_of[self.made] = np.arange(len(pairs))
        if (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        key = left << 16 | right
        self.order = np.argsort(key)
        self.key = np.r_[key[self.order], np.iinfo(np.int64).max]
        self.order = np.r_[self.order, _NEVER]
        # Signs of the byte alphabet lie below code point 512; the last of a pre-token may have symbols of its own.
        suffix = model.get("end_of_word_suffix") or ""
        self.inner, self.last = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in range(512):
            self.inner[c], self.last[c] = vocab.get(chr(c), -1), vocab.get(chr(c) + suffix, -1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.order[at], _NEVER)

    def symbols(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of pre-tokens in the byte alphabet, one after the other, and how many each has."""
        size = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        signs = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), "<u4")
        ids = self.inner[signs]
        end = np.cumsum(size) - 1
        ids[end[size > 0]] = self.last[signs[end[size > 0]]]
        return ids, size

    def merge(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many symbols of each sequence survive."""
        out = size.copy()
        start = np.cumsum(size) - size
        for s in np.flatnonzero(size > LONG).tolist():
            out[s] = len(self.merge_long(ids[start[s] : start[s] + size[s]]))
        who = np.flatnonzero((size > 1) & (size <= LONG))  # the sequences at work
        if not len(who):
            return out
        size = size[who]
        ids = ids[np.repeat(start[who] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        rank = self._all_ranks(ids, size)
        while True:
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            going = low < _NEVER
            if not going.all():
                out[who[~going]] = size[~going]
                on = np.repeat(going, size)
                ids, rank, who, size, low = ids[on], rank[on], who[going], size[going], low[going]
                if not len(who):
                    return out
            owner = np.repeat(np.arange(len(size)), size)
            hit = _apart(np.flatnonzero(rank == low[owner]))
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            # A merged symbol starts at the place of its left part; its pair and the one before it are new.
            moved = np.cumsum(stay) - 1
            size = size - np.bincount(owner[hit], minlength=len(size))
            ids, rank, owner, hit = ids[stay], rank[stay], owner[stay], moved[hit]
            before = hit[hit > 0] - 1
            for at in (hit, before):
                rank[at] = _NEVER
                two = at[at + 1 < len(ids)]
                two = two[owner[two] == owner[two + 1]]
                rank[two] = self.ranks(ids[two], ids[two + 1])

    def _all_ranks(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        rank = np.r_[self.ranks(ids[:-1], ids[1:]), _NEVER]
        rank[np.cumsum(size) - 1] = _NEVER
        return rank

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The symbols of one sequence that survive, rank by rank: all places of a rank at once."""
        n, ids = len(ids), ids.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there = np.ones(n, bool)
        rank = self._all_ranks(ids, np.array([n]))
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < _NEVER]
            if len(at):
                at = at[np.argsort(rank[at], kind="stable")]
                for some in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                    r = int(rank[some[0]])
                    if r not in places:
                        places[r] = []
                        heapq.heappush(ranks, r)
                    places[r].append(some)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[there[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Places that follow one another share a symbol: every second one merges, from the left.
            joined = np.r_[False, after[at[:-1]] == at[1:]]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
            gone = after[at]
            ids[at], there[gone], rank[gone] = self.made[r], False, _NEVER
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            changed = np.unique(np.r_[at, before[at]])
            changed = changed[changed >= 0]
            nxt = after[changed]
            rank[changed] = np.where(nxt < n, self.ranks(ids[changed], ids[np.minimum(nxt, n - 1)]), _NEVER)
            note(changed)
        return ids[there]


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places in order, every second one of a run of neighbours, from its first: neighbours share a symbol."""
    i = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], i, 0))
    return at[(i - first) % 2 == 0]


class _Numbers(dict):
    """Words to numbers; a word not met before gets the next number and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Counter:
    """Counts tokens as the library does for a .json file of a byte-level byte-pair vocabulary."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.merges = Merges(told["model"])
        tool = Tokenizer.from_file(path)
        self.normal = tool.normalizer.normalize_str if tool.normalizer else str
        self.cut = tool.pre_tokenizer.pre_tokenize_str
        # Where pre-tokens never hold white space, words are counted, and remembered, one by one.
        self.by_word = [p for p, _ in self.cut("a b  c")] == ["a", "b", "c"]
        self.simple = self.by_word and self.normal("AÀ\t b") == "aà b"
        added = told["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{name} has added tokens that take their surroundings in")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.forget()

    def forget(self) -> None:
        self.number, self.n = _Numbers(), np.empty(0, np.int64)

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        cut = [[w] if self.simple and w.isascii() and w.isalpha() else [p for p, _ in self.cut(w)] for w in new]
        left = self.merges.merge(*self.merges.symbols([p for c in cut for p in c]))
        sums = np.r_[0, np.cumsum(left)]
        ends = np.cumsum([len(c) for c in cut], dtype=np.int64)
        self.n = np.r_[self.n, sums[ends] - sums[np.r_[0, ends[:-1]]]]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), TOGETHER):
            if len(self.number) > REMEMBERED:
                self.forget()
            found, size = [], []
            for i, text in enumerate(texts[at : at + TOGETHER], at):
                parts = self.special.split(text) if self.special and self.special.search(text) else [text]
                out[i] = len(parts) - 1
                words = [w for p in parts for w in self._words(p)]
                found.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
                size.append(len(words))
            if self.number.new:
                self._learn()
            sums = np.r_[0, np.cumsum(self.n[np.concatenate(found)])]
            ends = np.cumsum(size)
            out[at : at + len(size)] += sums[ends] - sums[ends - size]
        return out

    def _words(self, part: str) -> list[str]:
        if self.simple and _plain(part):
            return part.lower().split()
        part = self.normal(part)
        return [w for w in part.split(" ") if w] if self.by_word else [part] if part else []


def _plain(text: str) -> bool:
    """Whether lower-casing and splitting it in Python gives what the tokenizer's normalizer would: Latin-1 is composed."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


def count(texts: list[str], name: str = TOKENIZER) -> np.ndarray:
    """The number of tokens of each text."""
    if name not in _loaded:
        _loaded[name] = Counter(name)
    return _loaded[name].count(texts)


def counted(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count(batch.column(2).to_pylist(), name)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = text_or_empty()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
