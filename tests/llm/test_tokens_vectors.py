"""Token counts, alignment of tokenizers and whitening against the libraries and plain computations."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from partloom.llm import alignment, queries, token_counts, whitening

from .helpers import docs

ODD = [
    None, "", " ", "x", "a" * 3000, "aaab" * 700, "<|endoftext|> a <|startoftext|><|endoftext|>b", "▁ no", "é́ 汉字 \x00 😀", "  two  spaces\n\nx", "İSTANBUL ΑΣ ς \u0085x\xa0y \x1cq",
    "it's we'll 'S 12 345!!! ???", "<0x41> </w> <s> Ġ", "汉字テスト" * 300, "x", "x",
]


def odd_texts(n=150):
    r = random.Random(5)
    sign = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x600), r.randrange(0x20, 0x3000), r.randrange(0x1F300, 0x1F600)]))
    return ODD + ["".join(sign() for _ in range(r.randrange(60))) for _ in range(n)] + ["".join(r.choice("abcdefgh") for _ in range(r.randrange(400, 1500))) for _ in range(6)]


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return words, plain, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_are_the_librarys(spark, tools):
    texts = odd_texts()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(docs(spark, texts), limit=100).collect()}
    want = [(len((t or "").encode()), len(tools[0].encode(t or "", add_special_tokens=False).ids)) for t in texts]
    assert got == {i: (b, n, n > 100) for i, (b, n) in enumerate(want)}
    assert token_counts.counted(docs(spark, [])).collect() == []


def test_token_counts_of_given_documents(spark, sf, tools):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf).collect()}
    want = {i: (len(t.encode()), len(tools[0].encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert got == {i: (b, n, n > 2048) for i, (b, n) in want.items()}


def test_other_byte_level_vocabulary(tools):
    texts = [t or "" for t in odd_texts(50)]
    with_special = [len(tools[1].encode(t, add_special_tokens=False).ids) for t in texts if "<|" not in t]
    assert token_counts.count([t for t in texts if "<|" not in t], "byte_bpe_50k.json").tolist() == with_special


def test_both_ways_of_merging_agree():
    merges = token_counts.Counter("word_bpe_49k.json").merges
    r = random.Random(3)
    words = ["".join(r.choice(s) for _ in range(r.randrange(1, 60))) for s in ("ab", "abc", "etaoin", "a") for _ in range(200)]
    ids, size = merges.symbols(words)
    left = merges.merge(ids, size)
    ends = np.cumsum(size)
    assert left.tolist() == [len(merges.merge_long(ids[e - s : e])) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]

    def one_by_one(symbols):
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = merges.ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
            if (best := int(ranks.argmin())) >= 0 and ranks[best] >= 1 << 40:
                break
            symbols[best : best + 2] = [int(merges.made[ranks[best]])]
        return len(symbols)

    assert left.tolist() == [one_by_one(ids[e - s : e].tolist()) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def plain_alignment(text, tools):
    """Tokens, groups, links and the text of the groups, by comparing every token with every other."""
    sides = alignment.sides()
    if not text:
        return None
    found = []
    for side, ids in zip(sides.of, (tools[1].encode(" " + text, add_special_tokens=False).ids, tools[2].encode(text)), strict=True):
        if b"".join(side.bytes[i] for i in ids) != (" " + text).encode():
            return None
        ends = np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
        found.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
    a, b = found
    common = sorted({x[2] for x in a} & {x[2] for x in b})
    inside = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if lo <= s and e <= hi)
    groups = ";".join(f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *common[:-1]], common, strict=True))
    links = collections.Counter((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)
    return len(a), len(b), len(common), links, hashlib.sha256(groups.encode()).hexdigest()


def aligned_plainly(texts, tools):
    each = [plain_alignment(t, tools) for t in texts]
    held = collections.Counter(p for e in each if e for p in e[3])
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = {}
    for i, e in enumerate(each):
        links = e[3] if e else {}
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        out[i] = (*(e[:3] if e else (0, 0, 0)), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), e[4] if e else "")
    return out


def test_alignment_equals_all_comparisons(spark, tools, monkeypatch):
    texts = [t[:400] if t else t for t in odd_texts(120)]
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = aligned_plainly(texts, tools)
    for slice_size in (alignment.SLICE, 300):
        monkeypatch.setattr(alignment, "SLICE", slice_size)
        monkeypatch.setattr(alignment, "TOGETHER", min(alignment.TOGETHER, slice_size))
        got = {r.doc_id: tuple(r[c] for c in columns) for r in alignment.aligned(docs(spark, texts)).collect()}
        assert got == want
    assert alignment.aligned(docs(spark, [])).collect() == []
    nothing = alignment.aligned(docs(spark, [None, ""])).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_of_given_documents(spark, sf):
    got = queries.op13_alignment(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in got if r.n_a)


def test_galloping_counts_what_is_below():
    r = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (40, 3000), (3000, 40), (700, 700)):
        x, y = (np.unique(r.integers(0, 5000, k)) for k in (n, m))
        assert alignment.ranks(x, y).tolist() == np.searchsorted(y, x).tolist()


def vectors(spark, given, ids=None):
    rows = [(i, v and [e if e is None else float(e) for e in v], "c", 1) for i, v in zip(ids or range(len(given)), given, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int")


def test_whitening_equals_plain_eigenvectors(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r.embedding for r in given], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, centred = len(x), x - x.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:32], vector[:, ::-1][:, :32]
    want = centred @ vector / np.sqrt(value)
    got = queries.op11_whitening(spark, sf).collect()
    assert len(got) == 32 * n
    place = {r.vec_id: i for i, r in enumerate(given)}
    z = np.empty((n, 32))
    for r in got:
        z[place[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((z * want).sum(axis=0))
    assert np.abs(z * signs - want).max() < 1e-9
    assert {(r.component, round(r.explained, 12)) for r in got} == {(i + 1, round(v / np.square(centred).sum() * n, 12)) for i, v in enumerate(value)}
    sums = x.sum(axis=0).tolist()
    exact = {r.vec_id: sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for r, row in zip(given, x, strict=True)}
    assert {r.vec_id: r.deviation for r in got} == exact
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12


def test_whitening_of_odd_vectors(spark):
    r = np.random.default_rng(2)
    good = r.standard_normal((60, 6)).tolist()
    bad = [None, [], [1.0, None, 2, 3, 4, 5], [math.nan, 1, 2, 3, 4, 5], [math.inf, 1, 2, 3, 4, 5], [1.0, 2.0]]
    got = whitening.whitened(vectors(spark, bad + good + good[:3])).collect()
    assert {x.vec_id for x in got} == set(range(6, 69)) and {x.n for x in got} == {63} and len(got) == 63 * 6
    assert sum(x.explained for x in got) / 63 == pytest.approx(1)
    for none in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3):
        assert whitening.whitened(vectors(spark, none)).collect() == []
    flat = whitening.whitened(vectors(spark, [[a, 1.0] for a in (0.0, 1.0, 2.0)])).collect()
    assert {x.component for x in flat} == {1} and sorted(abs(round(x.whitened, 9)) for x in flat) == [0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]
    far = whitening.whitened(vectors(spark, [[1e30, 0.0], [0.0, 1.0], [0.0, 0.0]])).collect()
    assert {x.deviation for x in far if x.vec_id == 0} == {None}


def test_whitening_in_a_narrow_search_space():
    """More dimensions than the search holds: restarts, locking and inner steps, against plain eigenvectors."""
    r = np.random.default_rng(4)
    for x in (r.standard_normal((800, 260)), r.standard_normal((500, 260)) * 0.9 ** np.arange(260), r.standard_normal((12, 200))):
        x = np.floor(8 * x)
        x -= x.mean(axis=0)
        v = x.T @ x / len(x)
        value, vector, made = whitening.jacobi_davidson(lambda b, x=x: x.T @ (x @ b) / len(x), x.shape[1], 32)
        assert np.abs(value - np.linalg.eigvalsh(v)[::-1][:32]).max() < 1e-13 * value[0]
        assert np.linalg.norm(v @ vector - vector * value, axis=0).max() < 1e-12 * value[0] and made < 400
