"""The pipeline's stages follow each other and keep the columns of documents."""

import re

import numpy as np
from conftest import SF

import corpus_pipeline
from tidepanel.llm.queries import table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        assert docs.columns == names
        now = docs.count()
        assert 0.5 * left < now <= left
        left = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {*names, "copies", "block"} <= set(last.columns) and last.count() > 0.5 * left


def first_ids(docs):
    """The smallest id of each group of texts linked by 5-word shingles at 0.8, by brute force."""
    sets, parent = {}, {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[i] = i

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted({root(i) for i in sets})


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):  # copies that differ in the last words, from far above 0.8 to far below
        n = int(rng.integers(3, 300)) if i % 15 else 5000
        words = [f"b{i}x{k}" for k in range(n)]
        rows += [(3 * i + j, " ".join(words[: n - int(n * cut)] + [f"e{i}y{j}" for _ in range(int(n * cut))])) for j, cut in enumerate((0.0, 0.06, rng.random() * 0.2))]
    rows += [(1000, "only four words here"), (1001, "only  Four words here"), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, SF).collect())
    assert got == first_ids(rows)
    assert 0 < len(got) < len(rows)
