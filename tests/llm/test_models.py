"""Quality and language models against plain versions that follow their definitions one letter at a time."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from partloom.llm import language, quality

from tests.llm.helpers import docs

_SAMPLES = ["The cat sat on the mat, and the dog sat on the log.", "the  cat\n ate 12 fish!", "Straße über Öl", "naïve café", "x", "привет мир", "a_b $5 = c;", "and the log sat on the cat", "the the the", "100 200 300"]


def _symbols(text):
    """Classes of a text's characters, written out from the module's description."""
    out = []
    for c in text:
        x = c.lower()[0]
        if ord(c) >= 0x250:
            s = 38
        elif x.isspace():
            s = 0
        elif "a" <= x <= "z":
            s = 1 + ord(x) - 97
        elif x.isdigit():
            s = 27
        elif x.isalpha():
            s = 28 + ord(x) % 8
        elif x in ".,;:!?'\"()-":
            s = 36
        else:
            s = 37 if ord(c) < 128 else 38
        if not (s == 0 and out and out[-1] == 0):
            out.append(s)
    return out


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over dictionaries: counts at the top, numbers of left contexts below it."""

    def __init__(self, texts, order=4, symbols=40):
        self.order, self.symbols = order, symbols
        top = Counter(g for t in texts for g in self.grams(t))
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            left = defaultdict(set)
            for g in self.counts[k + 1]:
                left[g[1:]].add(g[0])
            self.counts[k] = {g: len(s) for g, s in left.items()}
        self.discounts = {k: self.discount(c) for k, c in self.counts.items()}
        self.contexts = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.contexts[k][g[:-1]].append(n)

    def grams(self, text):
        x = [39] * (self.order - 1) + _symbols(text)
        return [tuple(x[i : i + self.order]) for i in range(len(x) - self.order + 1)]

    @staticmethod
    def discount(counts):
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        return [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1 * i), float(i)) if n[i] else 0.5 * i for i in (1, 2, 3)]

    def probability(self, g):
        if not g:
            return 1 / self.symbols
        k, lower = len(g), self.probability(g[1:])
        seen = self.contexts[k].get(g[:-1])
        if not seen:
            return lower
        cut = lambda n: self.discounts[k][min(n, 3)]
        n = self.counts[k].get(g, 0)
        return ((n - cut(n)) + sum(map(cut, seen)) * lower) / sum(seen)

    def perplexity(self, text):
        logs = [math.log2(self.probability(g)) for g in self.grams(text)]
        return 2 ** -(sum(logs) / len(logs))


@pytest.mark.parametrize("learned", [_SAMPLES, _SAMPLES[:1], ["aaaa aaaa", "aaab"], _SAMPLES * 3])
def test_perplexities_equal_plain_kneser_ney(spark, learned):
    r = random.Random(5)
    asked = [*_SAMPLES, "zebra quiz", "".join(r.choice("abcdefg hij. ") for _ in range(3000)) + "k"]
    plain = PlainKneserNey(learned)
    got = {x.doc_id: x.perplexity for x in quality.perplexities(docs(spark, asked), quality.smoothed(quality.count(docs(spark, learned)))).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(plain.perplexity(t), rel=1e-5), t


def _plain_vector(text):
    """The bundle of a text's bound trigrams, one trigram at a time; None without letters."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text or "").split()
    if not any(unicodedata.category(c)[0] == "L" for w in words for c in w):
        return None
    letters = [0 if c == " " else 1 + ord(c) % language.LETTERS for c in f" {' '.join(words).lower()} "]
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        first, second, third = (language._LETTER[x].astype(float) for x in (a, b, c))
        total += np.roll(first, 2) * np.roll(second, 1) * third
    return total / np.linalg.norm(total)


def test_languages_equal_plain_cosines(spark):
    texts = ["the cat and the dog", "a dog is on the mat", "der Hund und die Katze", "die Katze ist über dem Öl", "le chat et le chien", "où est le chien?", "привет, мир и люди", "", None, "12 34", "the Hund et кот", "xyzzy", "the cat and the dog " * 900]
    langs = ["en", "en", "de", "de", "fr", "fr", "ru", "en", "de", "fr", None, None, None]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    d = docs(spark, texts, langs=langs, ids=ids)
    seen = language.learn(d)
    sums = defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for t, lang in zip(texts, langs, strict=True):
        if lang is not None:
            v = _plain_vector(t)
            sums[lang] += 0 if v is None else v
    names = sorted(sums)
    assert seen.languages == names
    unit = {n: sums[n] / np.linalg.norm(sums[n]) for n in names}
    for r in language.identify(d, seen).collect():
        v = _plain_vector(texts[ids.index(r.doc_id)])
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        near = {n: float(v @ unit[n]) for n in names}
        assert near[r.lang_pred] >= max(near.values()) - 1e-5
        assert r.score == pytest.approx(max(0.0, near[r.lang_pred]), abs=2e-5)
