"""Character models of languages: held-out accuracy, a plain Kneser-Ney, rejection, odd rows."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import language_id
from tidepanel.llm.queries import QUERIES, table

DATA = "/root/testdata/sf0.01"


def plain_probability(texts, window, alphabet):
    """Interpolated Kneser-Ney by the book, with dictionaries."""
    order = language_id.ORDER
    counts = collections.Counter()
    for text in texts:
        run = " " * (order - 1) + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        counts.update(run[i : i + order] for i in range(len(run) - order + 1))
    p = 1 / alphabet
    levels = [counts]
    for _ in range(order - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    for level in reversed(levels):
        n = len(next(iter(level)))
        gram, context = window[-n:], window[-n:][:-1]
        once, twice = (sum(v == k for v in level.values()) or 0.5 for k in (1, 2))
        discount = once / (once + 2 * twice)
        after = {g: v for g, v in level.items() if g[:-1] == context}
        if after:
            total = sum(after.values())
            p = max(after.get(gram, 0) - discount, 0) / total + discount * len(after) / total * p
    return p


@pytest.fixture(scope="module")
def little(spark):
    rng = np.random.default_rng(2)
    words = {"xx": ["ba", "bo", "abba", "cab"], "yy": ["ti", "tot", "ott", "Übe"], "zz": ["ши", "ша", "аша"]}
    rows = [(i, " ".join(rng.choice(words[lang], 1 + i % 12)) + ".", lang) for i in range(240) for lang in [["xx", "yy", "zz"][i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_probabilities(spark, little):
    languages = language_id.train(little)
    texts = {lang: [] for lang in languages.models}
    for r in little.collect():
        crc = zlib.crc32(str(r.doc_id).encode())
        if crc % 4 != 2 and (crc >> 2) % 16:
            texts[r.lang].append(r.text)
    alphabet = 1 + len({c for some in texts.values() for t in some for c in t.lower() if c.isalpha()} | {" "})
    for lang, model in languages.models.items():
        for text in ("Ba abba", "ti übe tot", "q", "ша ba"):
            keys, _ = language_id.windows([text])
            run = "   " + text.lower() + " "
            want = [plain_probability(texts[lang], run[i : i + 4], alphabet) for i in range(len(keys))]
            assert np.allclose(np.exp(model.log_prob(keys)), want, rtol=1e-6)


def test_held_out_accuracy(spark):
    docs = table(spark, DATA, "documents")
    got = QUERIES["op12_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.97 * len(unseen)
    taken = [r for r in unseen if r.accepted]
    assert len(taken) >= 0.9 * len(unseen) and sum(r.lang_pred == r.lang for r in taken) >= 0.985 * len(taken)


def test_labels_of_held_out_rows_do_not_matter(spark, little):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    wrong = little.withColumn("lang", F.when(crc % 4 == 2, "ww").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language_id.predicted(d, language_id.train(d)).collect())) for d in (little, wrong))
    assert a == b


def test_foreign_letters_are_not_accepted(spark, little):
    strange = spark.createDataFrame([(1, "παρα πολυ καλα λεει ο φιλος μου")], "doc_id long, text string")
    row = language_id.predicted(strange, language_id.train(little)).first()
    assert row.lang_pred in ("xx", "yy", "zz") and not row.accepted


def test_odd_rows(spark, little):
    odd = [(None, "ba bo", "xx"), (1, None, "xx"), (2, "", "yy"), (3, "123 ... !", "yy"), (4, "ba " * 100_000, "xx"), (4, "ba " * 100_000, "xx"), (5, "𐐀𐐁 ba", None), (6, "\x00ti\ntot", "yy"), (7, "a", "xx")]
    frame = little.unionByName(spark.createDataFrame(odd, little.schema)).selectExpr("*", "1 as score", "'k' as lang_pred", "2 as best")
    got = language_id.predicted(frame, language_id.train(frame))
    assert got.columns == ["doc_id", "lang_pred", "score", "accepted", "cross_entropy"] and got.count() == 240 + len(odd)
    last = [tuple(r)[:4] for r in got.collect()[-len(odd) :]]
    assert [r[1] for r in last[:6]] == ["xx", "und", "und", "und", "xx", "xx"] and last[7][1] == "yy"
    assert last[1] == (1, "und", 0.0, False) and last[4] == last[5]
    nothing = frame.limit(0)
    assert language_id.predicted(nothing, language_id.train(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.predicted(frame, language_id.train(frame.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_bounded_model(spark, little, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_GRAMS", 12)
    monkeypatch.setattr(language_id, "LOCAL", 5)
    got = language_id.predicted(little, language_id.train(little)).join(little.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() > 0.9 * 240


def test_entries_beyond_the_bound_count(spark, little, monkeypatch):
    odd = [(None, "ba bo", "xx"), (900, None, "xx"), (901, "123", "yy"), (902, "ba ti ша " * 500, None), (902, "ba ti ша " * 500, None), (903, "quite other letters", None)]
    frame = little.unionByName(spark.createDataFrame(odd, little.schema))

    def found():
        rows = language_id.predicted(frame, language_id.train(frame)).collect()
        return sorted((r.doc_id or -1, r.lang_pred, r.accepted, round(r.score, 9), round(r.cross_entropy, 9)) for r in rows)

    whole = found()
    for bound, bits in ((12, 26), (3, 15)):
        monkeypatch.setattr(language_id, "MODEL_GRAMS", bound)
        monkeypatch.setattr(language_id, "BITMAP", bits)
        assert found() == whole


def test_bitmap_marks_what_was_left_out(spark):
    keys = np.arange(1, 5000, dtype=np.uint64) << np.uint64(40) | np.uint64(1 << 63)
    bitmap = language_id._bitmap(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "gram long"), 20)
    assert language_id._marked(bitmap, keys).all() and language_id._marked(bitmap, keys + np.uint64(1)).mean() < 0.02
