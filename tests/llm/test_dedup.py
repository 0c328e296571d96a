import hashlib
import random

import numpy as np
import pytest
import xxhash
from partloom.llm import exact_dedup, near_text, simhash
from partloom.llm.components import components
from partloom.llm.queries import op1_simhash

from tests.llm.helpers import docs, rows


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    return linked(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)


def slow_groups(texts):
    """texts: (doc_id, text). Groups of texts whose sets of five-word shingles are similar by 0.8 or more."""
    sets = []
    for _, t in texts:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    return linked([d for d, _ in texts], lambda i, j: alike(sets[i], sets[j]))


def linked(ids, near):
    up = dict(enumerate(range(len(ids))))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}


def test_fingerprint_by_bits():
    for t in [None, "", " \n", "One", "one TWO", "A b c d e f", "É a É b\x0bc\x1cd", "x " * 500]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()}
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in given]
    want = slow_components([r.doc_id for r in given], fps)
    assert got == {r.doc_id: (f"{f:016x}", want[r.doc_id]) for r, f in zip(given, fps, strict=True)}
    assert any(k != v for k, v in want.items())


def near_links(spark, fps):
    given = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    ways = simhash._variants(given).repartition(3, "key").sortWithinPartitions("key", "fp")
    return components(ways.mapInArrow(simhash._links, "a long, b long").distinct())


def test_every_pair_within_three_bits_is_linked(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = set(centres)
    for c in centres:
        for n in (1, 2, 3, 4, 5):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    got = {r.node & simhash._ALL: r.root & simhash._ALL for r in near_links(spark, fps).collect()}
    want = slow_components(list(range(len(fps))), fps)
    groups = lambda of: {frozenset(k for k in range(len(fps)) if of(k) == v) for v in map(of, range(len(fps)))}
    assert groups(lambda k: got.get(fps[k], fps[k])) == groups(lambda k: want[k])


def test_large_bucket_is_searched_exactly():
    rng = np.random.default_rng(0)
    for low, width in simhash.BLOCKS:
        mask = np.uint64(((1 << width) - 1) << low)
        rest = np.uint64(rng.integers(0, 1 << 63)) & ~mask
        values = rng.choice(1 << 12, 1200, replace=False).astype(np.uint64)
        outside = [b for b in range(64) if not low <= b < low + width]
        fps = np.array([rest ^ (v << np.uint64(low)) ^ (np.uint64(1 << outside[i % 5]) if i % 3 else np.uint64(0)) for i, v in enumerate(values)], np.uint64)
        a, b = simhash._near_in_projection(rest, fps, low, width)
        assert (np.bitwise_count(a ^ b) <= 3).all()
        forest = simhash._Forest()
        forest.link(a, b)
        x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
        # Links that only other buckets must find are those between two members off the centre on different sides.
        for p, q in zip(fps[x].tolist(), fps[y].tolist(), strict=True):
            e, r = ((p ^ q) & int(mask)).bit_count(), ((p ^ q) & ~int(mask)).bit_count()
            at_centre = (p & ~int(mask)) == int(rest) or (q & ~int(mask)) == int(rest)
            if e <= 1 or (e == 2 and at_centre) or (e == 3 and r == 0 and at_centre):
                assert forest.root(p) == forest.root(q)


def test_simhash_edges(spark):
    d = docs(spark, [None, "", " \n ", "a b c d e", "a b c d e", "other words here now"], ids=[5, 3, 9, 7, 7, 1])
    got = sorted(rows(simhash.near_groups(d)))
    assert [(i, c) for i, _, c in got] == [(1, 1), (3, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    assert simhash.near_groups(d.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.first_of_each_group(d).collect()) == [1, 3, 7, 7]
    long = docs(spark, ["w1 w2 w3 " * 200_000, "x"])
    assert simhash.near_groups(long).count() == 2


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 300)]
    got = dict(rows(components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long"))))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 300)}


def test_exact_classes(spark):
    d = docs(spark, [None, "", "a", "a", "A", "a ", "a"], ids=[1, 2, 3, 4, 5, 6, 4])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.classes(d).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 2, False, sha("")), 2: (2, 2, True, sha("")), 3: (4, 3, False, sha("a")), 4: (4, 3, True, sha("a")), 5: (5, 1, True, sha("A")), 6: (6, 1, True, sha("a "))}
    assert exact_dedup.classes(d).count() == 7
    assert exact_dedup.classes(d.limit(0)).count() == 0
    null_id = docs(spark, ["q", "q", "z"], ids=[None, 4, None])
    assert sorted(((r.doc_id, r.kept) for r in exact_dedup.classes(null_id).collect()), key=str) == [(4, True), (None, False), (None, True)]


def test_distinct_rows_keep_all_columns(spark):
    d = docs(spark, [None, "", "a", "a", "a"], ids=[3, 2, 5, 9, 9], sources=["x", "y", None, "z", "z"])
    kept = exact_dedup.distinct_rows(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text, r.source, r.body) for r in kept.collect()) == [(3, None, "x", "b"), (9, "a", "z", "b")]


def test_near_texts_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for k in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 300))] + (passage if k % 3 == 0 else [])
        texts.append(" ".join(base))
        for _ in range(k % 4):
            edited = base.copy()
            for at in rng.sample(range(len(edited)), rng.randrange(1, max(2, len(edited) // 40))):
                edited[at] = rng.choice(words)
            texts.append(" ".join(edited))
    texts += [None, "", "a b", "A  b", "a b c"] + [" ".join([*passage, "x", f"y{i}"]) for i in range(150)]
    given = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    d = docs(spark, texts, ids=[i for i, _ in given])
    want = slow_groups(given)
    kept = near_text.first_of_each_group(d)
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == d.columns
    assert len(set(want.values())) < len(want) - 150
    assert near_text.first_of_each_group(d.limit(0)).count() == 0


def family(rng, size, length=200, edits=4):
    """Texts that differ from one text in a few words each: most pairs are alike in fingerprint, few by shingles."""
    base = [f"b{rng.randrange(10_000)}" for _ in range(length)]
    made = []
    for _ in range(size):
        text = base.copy()
        for at in rng.sample(range(length), edits):
            text[at] = f"e{rng.randrange(10**9)}"
        made.append(" ".join(text))
    return made


@pytest.mark.parametrize("sizes", [(800, 4), (500, 3), (700, 1)])
def test_families_of_mostly_unlike_texts(spark, sizes):
    """A template with few words changed fills large buckets; no link may be lost in them."""
    rng = random.Random(sum(sizes))
    texts = family(rng, sizes[0], edits=sizes[1]) + family(rng, 30, 60, 1)
    given = list(zip(rng.sample(range(100_000), len(texts)), texts, strict=True))
    kept = {r.doc_id for r in near_text.first_of_each_group(docs(spark, texts, ids=[i for i, _ in given])).collect()}
    assert kept == set(slow_groups(given).values())


def test_tiles_of_a_crowd(spark, monkeypatch):
    """A crowd in many tiles, with buckets that are all large, gives the same groups."""
    rng = random.Random(12)
    texts = family(rng, 150) + family(rng, 100, edits=2)
    given = list(enumerate(texts))
    monkeypatch.setattr(near_text, "TILE", 40)
    monkeypatch.setattr(near_text, "SMALL", 2)
    kept = {r.doc_id for r in near_text.first_of_each_group(docs(spark, texts)).collect()}
    assert kept == set(slow_groups(given).values())
