"""The model of unfolded characters behind op4 against a plain one, and texts that folded characters can't tell apart."""

import random

import pytest
from partloom.llm import ngrams, quality

from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tests.llm.test_models import PlainKneserNey

_LEARNED = ["The cat sat on the mat, and the dog sat on the log.", "the  cat\n ate 12 fish!", "Straße über Öl", "x", "привет, мир", "日本語 の 文", "a\x00b\x00", "x", "the the the", "\U0001f600 ok"]


class _PlainCharacters(PlainKneserNey):
    def grams(self, text):
        x = "\n" * (self.order - 1) + " ".join(text.split())
        return [x[i : i + self.order] for i in range(len(x) - self.order + 1)]


@pytest.mark.parametrize(("slice_size", "chunk"), [(ngrams.SLICE, ngrams.CHUNK), (30, 20)])
@pytest.mark.parametrize("n", [len(_LEARNED), 1, 0])
def test_perplexities_equal_plain_kneser_ney_of_characters(spark, monkeypatch, slice_size, chunk, n):
    monkeypatch.setattr(ngrams, "SLICE", slice_size)
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    r = random.Random(3)
    asked = [*_LEARNED, "zebra quiz", "мир привет", "文 本", " ".join(r.choice(["the", "cat", "привет", "12"]) for _ in range(300))]
    plain = _PlainCharacters(_LEARNED[:n], ngrams.ORDER, ngrams.CHARACTERS)
    learned = spark.range(n).select(F.col("id").alias("doc_id"))
    got = {x.doc_id: x.perplexity for x in ngrams.perplexities(docs(spark, asked).repartition(3, "doc_id"), learned).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(plain.perplexity(t), rel=1e-5), t


def test_many_characters_need_ranks():
    r = random.Random(1)
    rows = [(i, "zh", "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(9000))) for i in range(3)]
    blob = ngrams._blob(rows)
    got = [g for _, grams, _ in ngrams._counted(((0, [blob]), [])) for g in grams]
    plain = {("\n" * 4 + t)[i : i + 5] for _, _, t in rows for i in range(len(t))}
    assert len({c for g in got for c in g}) ** 5 > 2**63 and len(got) == len(set(got)) and set(got) == plain


def test_quality_tells_letters_beyond_latin_apart(spark):
    """Words of good Russian and Greek against the same with their letters replaced by others of the script."""
    r = random.Random(7)
    words = {"ru": "мама мыла раму а папа читал газету и пил чай у окна в саду".split(), "el": "η γάτα κάθισε στο χαλί και ο σκύλος έτρεξε στον κήπο".split()}
    good = [(lang, " ".join(r.choice(w) for _ in range(60))) for lang, w in words.items() for _ in range(20)]
    letters = {lang: sorted(set("".join(w))) for lang, w in words.items()}
    bad = [(lang, "".join(c if c == " " else r.choice(letters[lang]) for c in t)) for lang, t in good]
    d = docs(spark, [t for _, t in good + bad], langs=[lang for lang, _ in good + bad])
    labels = spark.range(len(good)).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.judged(d, labels).collect()
    assert len(got) == len(d.collect())
    assert {x.doc_id for x in got if not x.kept} >= set(range(len(good), 2 * len(good)))
    assert sum(x.kept for x in got) >= 0.9 * len(good)


def test_quality_counts_repeated_rows_and_null_ids(spark):
    d = docs(spark, ["some words here", "some words here", "other words", "some words here"], ids=[1, 1, 2, None])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(d, labels).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "2", "None"]
    assert len({x.perplexity for x in got if x.doc_id != 2}) == 1
