import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
from partloom.llm import mixing, packing
from partloom.llm.queries import SQL, op3_packing, op10_mixing
from tokenizers import Tokenizer

from tests.llm.helpers import docs, rows

TOOL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_pieces(pieces, texts):
    """texts: list of (doc_id, text). Every id in one piece, sequences gapless, no padding but for powers of two."""
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append(TOOL.encode(t or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        if len(ids[d]) > 1:
            continue
        at, want = 0, ids[d][0]
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0
    assert sum(p.length for p in pieces) == sum(len(x) for v in ids.values() for x in v)


def test_packing_query(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = op3_packing(spark, sf).collect()
    check_pieces(got, [(r.doc_id, r.text) for r in given])
    assert sorted(map(tuple, got)) == sorted(map(tuple, op3_packing(spark, sf).collect()))


def test_packing_edges(spark):
    texts = [None, "", "Hello, world's end!", "same text", "same text", "long words here " * 9000]
    d = docs(spark, texts, ids=[1, 2, 3, 4, 5, 6])
    check_pieces(packing.sequences(d).collect(), list(zip([1, 2, 3, 4, 5, 6], texts, strict=True)))
    check_pieces(packing.sequences(d, shard=500).collect(), list(zip([1, 2, 3, 4, 5, 6], texts, strict=True)))
    assert packing.sequences(d.limit(0)).count() == 0
    repeated = docs(spark, ["a b", "a b"], ids=[7, 7])
    assert packing.sequences(repeated).count() >= 2


def test_tokens_equal_the_tokenizers_own():
    rng = random.Random(3)
    letters = "aAbZzéÉßÿ'’.,!0159²½ª µ\t\n\xa0\x85\x1c<|>ſİΣσe\u0301中文😀-_\x01"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + ["<|endoftext|> it's we'll 'the I'VE d'd", ""]
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() for x in packing.encode_batch(texts, "word_bpe_49k.json")]
        assert got == [TOOL.encode(t, add_special_tokens=False).ids for t in texts]


def test_neighbours_share_words():
    topics = [np.array([10 * k + i for i in range(8)] * 4, np.uint16) for k in (1, 2, 3)]
    shard = [topics[i % 3] for i in range(30)]
    pieces = packing.pack(shard, np.ones(1 << 16), 32.0, window=32 * 10)
    assert all(len({p[0] % 3 for p in pieces if p[3] == s}) == 1 for s in range(3))


def test_a_window_goes_on_with_its_seeds_neighbours():
    topics = [np.array([100 * k + i for i in range(8)] * 4, np.uint16) for k in (1, 2, 3)]
    shard = [topics[i % 3][: 20 + i // 3 % 12] for i in range(360)]
    pieces = packing.pack(shard, np.ones(1 << 16), 25.5, window=3060)
    assert all(len({p[0] % 3 for p in pieces if p[3] == s}) == 1 for s in range(3))


def test_a_seed_asks_for_all_its_terms():
    idf = np.ones(1 << 16)
    idf[100:140] = 2
    seed, other, near = np.arange(100, 190), np.arange(1000, 1090), np.arange(140, 230)
    pieces = packing.pack([x.astype(np.uint16) for x in (seed, other, near)], idf, 90.0, window=180)
    assert {p[0] for p in pieces if p[3] == 0} == {0, 2}


def test_near_documents_meet_in_a_shard(spark):
    rng = random.Random(5)
    words = sorted(w[:-4] for w in TOOL.get_vocab() if w.endswith("</w>") and w[:-4].isalpha() and w.isascii())
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(58)]
        texts += [" ".join(base), " ".join([*base[:56], "edited"])]
    got = packing.sequences(docs(spark, texts), shard=1000).collect()
    check_pieces(got, list(enumerate(texts)))
    of = {p.doc_id: p.sequence_id >> 32 for p in got}
    assert len(set(of.values())) > 5
    assert sum(of[i] == of[i + 1] for i in range(0, 120, 2)) >= 40


@pytest.mark.parametrize("sizes", [[5], [10, 10, 10], [1000, 1, 1, 50, 3], [7] * 23, [0, 0], [100, 0, 3]])
def test_targets_reach_the_fixpoint(spark, sizes):
    w = [Fraction(mixing.WEIGHTS[i % 3]) for i in range(len(sizes))]
    target, fixed = [Fraction(0)] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = sum(sizes) - sum(3 * sizes[i] for i in fixed)
        for i in free:
            target[i] = left * w[i] / sum(w[j] for j in free)
        over = [i for i in free if target[i] > 3 * sizes[i]]
        for i in over:
            target[i] = Fraction(3 * sizes[i])
        fixed |= set(over)
        if not over:
            break
    given = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(given).orderBy("source").collect()]
    assert got == pytest.approx([float(t) for t in target])


def test_mixing_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_mixing(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(SQL["op10_mixing"]).df()
    order = sorted(got.columns)
    assert got[order].sort_values(order).values.tolist() == want[order].sort_values(order).values.tolist()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sums = got.assign(source=got.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= 0.02 * sums.target + 64).all() and (got.taken <= 3 * got["size"]).all()


def test_mixing_edges(spark):
    d = docs(spark, [None, "", "a b c", "a b c", "d " * 500, "e"], sources=["x", None, "x", "x", None, "y"], ids=[1, 2, 3, 3, 4, 5])
    got = {(r.doc_id, r.size): (r.source_size, r.taken) for r in mixing.taken(d).collect()}
    assert mixing.taken(d).count() == 6 and got[1, 0] == (6, 0) and got[4, 500][0] == 500
    assert mixing.taken(d.limit(0)).count() == 0


def test_mixed_rows_hold_the_words_taken(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{i}_{j}" for j in range(rng.randrange(1, 400))) for i in range(60)]
    d = docs(spark, texts, sources=[f"s{i % 7 % 4}" for i in range(60)])
    mixed = mixing.mixed_rows(d)
    assert mixed.columns == d.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text) and r.body == "b"
    assert {k: v for k, v in words.items() if v} == {r.doc_id: r.taken for r in mixing.taken(d).collect() if r.taken}
    assert sorted(rows(mixed)) == sorted(rows(mixing.mixed_rows(d)))


def slow_block(slot, blocks, sid, turn):
    """The block that a slot takes, by big integers and as many passes as it needs."""
    a = next(a for a in range(1, blocks + 2) if a * a >= blocks)
    b = -(-blocks // a)
    x = slot
    while True:
        left, right = divmod(x, b)
        for i, seed in enumerate(mixing.STEPS):
            key = sid * 7919 + turn * 104729 + seed
            if i % 2 == 0:
                left = (left + pow(right + key, 5, mixing.PRIME)) % a
            else:
                right = (right + pow(left + key, 5, mixing.PRIME)) % b
        x = left * b + right
        if x < blocks:
            return x


def test_shards_draw_counts_and_slots_are_permuted(spark):
    sizes = {1: (1, 3), 2: (2, 2), 3: (7, 19), 4: (1000, 2500), 5: (997, 996)}
    plan = spark.createDataFrame([(sid, blocks, slots) for sid, (blocks, slots) in sizes.items()], "sid long, blocks long, slots long")
    counts = defaultdict(int)
    for r in mixing.shard_counts(plan, 16).collect():
        counts[r.sid] += r.n
    assert counts == {sid: slots for sid, (_, slots) in sizes.items()}
    got = defaultdict(list)
    shards = defaultdict(set)
    for r in mixing._taken_blocks(plan, 16).collect():
        got[r.sid].append((r.slot, r.round, r.block))
        shards[r.sid, r.shard].add(r.slot)
    for sid, (blocks, slots) in sizes.items():
        assert sorted(got[sid]) == [(j, j // blocks, slow_block(j % blocks, blocks, sid, j // blocks)) for j in range(slots)]
        times = np.bincount([b for _, _, b in got[sid]], minlength=blocks)
        assert times.min() >= slots // blocks and times.max() <= -(-slots // blocks)
    assert all(max(s) - min(s) == len(s) - 1 for s in shards.values())
    n = np.array([len(shards[4, h]) for h in range(16)])
    assert 100 < n.min() and n.max() < 230 and len(set(n)) > 4  # 156 on average, with a deviation of 12
    taken = np.sort([b for _, e, b in got[4] if e == 2])  # 500 of 1000 blocks: neither one run nor a comb
    assert 180 < (np.diff(taken) == 1).sum() < 320


def test_mixed_rows_are_stretches_of_the_text(spark):
    rng = random.Random(6)
    texts = [" \n" * (i % 3) + "".join(f"w{i}_{j}" + rng.choice([" ", "\n\n", "\t "]) for j in range(rng.randrange(1, 500))) for i in range(40)]
    d = docs(spark, texts, sources=[f"s{i % 5 // 4}" for i in range(40)])
    seen = 0
    for r in mixing.mixed_rows(d).collect():
        whole = texts[r.doc_id]
        at = whole.index(r.text)
        assert r.text == whole or (at + len(r.text) == len(whole) or whole[at + len(r.text)].isspace()) and r.text.strip() == r.text
        seen += r.text != whole
    assert seen > 5
    held = defaultdict(int)
    for r in mixing.shard_rows(d).collect():
        held[r.doc_id] += r.words
    assert held == {r.doc_id: r.taken for r in mixing.taken(d).collect() if r.taken}


def test_scores_against_plain_bm25():
    rng = np.random.default_rng(2)
    shard = [np.r_[rng.zipf(1.3, rng.integers(0, 120)).clip(1, 900) + 5, packing.END].astype(np.uint16) for _ in range(300)]
    idf = rng.random(1 << 16) + 0.1
    mean = sum(map(len, shard)) / len(shard)
    index = packing.Index(shard, idf, mean)
    used = np.zeros(300, bool)

    def slow(seed, doc):
        words = set(shard[seed].tolist()) & set(shard[doc].tolist()) - {packing.END}
        tf = {w: int((shard[doc] == w).sum()) for w in words}
        return sum(idf[w] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(shard[doc]) / mean)) for w, n in tf.items())

    for seed in (0, 7, 150, 299):
        got = index.scores(seed)
        assert np.allclose([got[d] for d in range(300) if not used[d]], [slow(seed, d) for d in range(300) if not used[d]], rtol=1e-5)
        used[rng.choice(300, 120, replace=False)] = True
        used[299] = False
        index.forget(used)
    assert packing._keys([np.array([packing.END], np.uint16), shard[1]], idf).shape == (2,)
