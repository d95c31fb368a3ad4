"""Collocations against brute force, and the filters' round trips."""

import collections
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidepanel.llm import collocations
from tidepanel.llm.collocations import Permutation, counted, packed, unpacked
from tidepanel.llm.queries import QUERIES, table


def brute_force(rows, least=10, covered=50):
    """(lang, phrase, a, l, r, score) of all candidates, and the words of each language."""
    grams, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                grams.update((lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    found = {k: a for k, a in grams.items() if len(k) > 2 and a >= least}
    out = set()
    for (lang, *words), a in found.items():
        if len(words) == 2 and any(k[0] == lang and tuple(words) in (k[1:3], k[2:4]) and 100 * b >= covered * a for k, b in found.items() if len(k) == 4):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = grams[(lang, *words[:k])], grams[(lang, *words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.add((lang, " ".join(words), a, left, right, score))
    return out, {k: v for k, v in totals.items() if v}


def same(spark, docs, least=10):
    phrases, totals = collocations.mined(docs, least)
    want, words = brute_force([(r.lang, r.text) for r in docs.select("lang", "text").collect()], least)
    assert collections.Counter(tuple(r) for r in phrases.select("lang", "phrase", "a", "l", "r", "score").collect()) == collections.Counter(want)
    assert {r.lang: r.n for r in totals.collect()} == words
    return want


@pytest.fixture
def small(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(25)] + ["New", "York", "é", "a\u00a0b"]
    rows = []
    for i in range(150):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", " ", "  ", "\t", ". ", "\r", ",x "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(int(rng.integers(0, 80))))
        rows.append((i, text + " new york city " * (i % 3), ["en", "de", None][i % 3], 1, "x"))
    rows += [(None, None, "en", 1, "x"), (3, "", None, 1, "x"), (3, "once only", "fr", 1, "x"), (5, "go on " * 30_000, "long", 1, "x"), (5, "go on " * 30_000, "long", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, hash int, word string").repartition(3)


def test_brute_force(spark, small):
    assert len(same(spark, small, 3)) > 100


def test_many_stretches_and_full_shards(spark, small, monkeypatch):
    for name, value in {"STRETCH": 50, "LOCAL": 60, "CHUNK": 7}.items():
        monkeypatch.setattr(collocations, name, value)
    same(spark, small, 4)


def test_without_dictionary(spark, small, monkeypatch):
    monkeypatch.setattr(collocations, "DICTIONARY", 3)
    monkeypatch.setattr(collocations, "STRETCH", 500)
    same(spark, small)


def test_given_tables_and_nothing(spark):
    docs = table(spark, SF, "documents")
    got = QUERIES["op11_collocations"](spark, SF).collect()
    want, words = brute_force([(r.lang, r.text) for r in docs.collect()])
    ranked = []
    for lang, n in words.items():
        best = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[5], -w[2], w[1].encode()))[:2000]
        ranked += [(lang, i + 1, p, a, left, right, n, s) for i, (_, p, a, left, right, s) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(ranked)
    phrases, totals = collocations.mined(docs.where(F.lit(False)))
    assert phrases.count() == totals.count() == 0


@pytest.mark.parametrize("bits,words", [(20, 1), (57, 1), (63, 1), (64, 3)])
def test_permutation_and_filter_round_trip(bits, words):
    rng = np.random.default_rng(bits)
    keys = rng.integers(0, 1 << min(bits, 63), (words, 5000), dtype=np.uint64)
    order = Permutation(bits)
    assert (order.undo(order.apply(keys)) == keys).all()
    if bits == 20:
        every = np.arange(1 << bits, dtype=np.uint64)[None]
        assert len(np.unique(order.apply(every))) == 1 << bits
    sorted_keys, counts = counted(order.apply(keys))
    counts[::7] = rng.integers(1, 1 << 40, len(counts[::7]))
    for known in (0, 3):
        for prefix in range(1 << known):
            part = (sorted_keys[0] >> np.uint64(bits - known)) == np.uint64(prefix) if known else np.ones(len(counts), bool)
            for take in (part, part & (np.cumsum(part) <= 1)):
                data = packed(sorted_keys[:, take], counts[take], bits, known)
                back, many = unpacked(data, bits, known, prefix, words)
                assert (back == sorted_keys[:, take]).all() and (many == counts[take]).all()
