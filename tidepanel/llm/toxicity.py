"""Toxic documents by a subsequence string kernel, a Nyström map and a linear SVM over words.

The kernel compares words by their common three-letter subsequences, each weighted by ``DECAY`` to
the power of its span, so inserted or missing letters cost a little and not the match.  Letters are
lower-cased and everything between them within a token dropped; a run of single letters counts as one word.

Training (documents outside the held-out fold, at most ``TRAIN_DOCS`` of them):

1. Words with a piece of five letters that toxic documents hold far beyond chance are witnesses; words of clean
   documents are counterexamples.
2. Landmarks are drawn from both; the Nyström map is ``K(x, landmarks) K(landmarks, landmarks)^-1/2``.
3. A linear SVM is fitted to the mapped words, witnesses also with two letters put in, and again with the clean words that scored highest.
4. A document's margin is that of its most toxic word.  A logistic curve over margins of whole training
   documents gives scores between 0 and 1.

As the SVM is linear in kernel values and those are linear in subsequence weights, the model folds
into one weight per subsequence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import held_out, kept, sampled, texts_of

#: At most so many labelled documents are learnt from.
TRAIN_DOCS = 6000
LANDMARKS = 192
WITNESSES = 512
#: Letters of the pieces by which words are found to be witnesses.
PIECE = 5
COUNTEREXAMPLES = 4000
DECAY = 0.75
#: The widest subsequence, from its first to its last letter.
SPAN = 6
#: Longer words are read through windows of this many letters, half overlapping.
WINDOW = 24
#: Words below this margin tell nothing more.
FLOOR = -0.3
CACHED_WORDS = 200_000

_NOISE = re.compile(r"[^\w\s]|[\d_]")
_SPELLED = re.compile(r"(?<!\S)[^\W\d_][^\w\s]?(?:\s+[^\W\d_][^\w\s]?){2,}(?!\S)")
_CODES = 32
_GRAMS = np.array([(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)])
_WEIGHTS = DECAY ** (_GRAMS[:, 1] + 1.0)
_REAL = np.ones(_CODES**3, bool)
for _place in (1, _CODES, _CODES**2):
    _REAL[np.arange(_CODES**3) // _place % _CODES == 0] = False


def tokens_of(text: str) -> set[str]:
    """The distinct tokens between white space, lower-cased, and the words that runs of single letters spell."""
    text = text.lower()
    found = set(text.split())
    if sum(t[0].isalpha() and not t[1:].isalnum() for t in [t for t in found if len(t) < 3]) > 2:
        found.update(_NOISE.sub("", "".join(run.split())) for run in _SPELLED.findall(text))
    return found


def windows_of(token: str) -> list[str]:
    """The letters of a token, in half overlapping windows if they are many."""
    word = token if token.isalpha() else _NOISE.sub("", token)
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _letters(words: list[str]) -> np.ndarray:
    """Letters as numbers from 1, 0 beyond a word's end; letters past a-z fold onto few codes."""
    width = max([3, *map(len, words)])
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)
    return np.where(points == 0, 0, np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 5))


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, float]]:
    """For each spacing of three letters: the code of every place of every word, and the spacing's weight."""
    letters = _letters(words)
    width = letters.shape[1]
    padded = np.zeros((len(words), width + SPAN), np.int32)
    padded[:, :width] = letters
    first = padded[:, : width - 2] << 10
    for (j, k), weight in zip(_GRAMS, _WEIGHTS, strict=True):
        yield first | padded[:, j : j + width - 2] << 5 | padded[:, k : k + width - 2], weight


def _norms(words: list[str]) -> np.ndarray:
    """The length of a word's vector if no subsequence repeats; it depends on the number of letters only."""
    lengths = np.array([len(w) for w in words])
    places = np.maximum(0, lengths[:, None] - _GRAMS[:, 1][None, :])
    return np.sqrt(np.maximum(places @ _WEIGHTS**2, 1e-12))


def _features(words: list[str]) -> np.ndarray:
    """Scaled vectors of subsequence weights, (words, codes); for few words."""
    out = np.zeros((len(words), _CODES**3), np.float32)
    rows = np.arange(len(words))[:, None]
    for codes, weight in _subsequences(words):
        np.add.at(out, (rows, codes), weight)
    out[:, ~_REAL] = 0
    return out / _norms(words)[:, None].astype(np.float32)


def margins(words: list[str], gains: np.ndarray, offset: float) -> np.ndarray:
    """The SVM's decision value of each word.  ``gains`` are 0 for codes that no three letters have."""
    raw = np.zeros(len(words))
    for codes, weight in _subsequences(words):
        raw += weight * gains[codes].sum(axis=1)
    return raw / _norms(words) - offset


def token_margins(tokens: list[str], gains: np.ndarray, offset: float) -> list[float]:
    """The margin of each token's most toxic window; short and long tokens apart, as batches are as wide as their widest."""
    parts = [windows_of(t) for t in tokens]
    owners = np.repeat(np.arange(len(tokens)), [len(p) for p in parts])
    words = [w for p in parts for w in p]
    out = np.full(len(tokens), -1.0 - offset)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 4000):
        some = order[at : at + 4000]
        np.maximum.at(out, owners[some], margins([words[i] for i in some], gains, offset))
    return out.tolist()


@dataclass
class Model:
    """``gains``: a weight per subsequence; ``offset``: of the SVM; ``curve``: slope and shift of the logistic."""

    gains: np.ndarray
    offset: float
    curve: tuple[float, float]

    def score(self, margin: np.ndarray) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))


def _document_margins(gains: np.ndarray, offset: float) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to the margin of each text's most toxic token, ``FLOOR`` at least.

    Tokens met before are remembered, as many as ``CACHED_WORDS``; only those above the floor with their margin.
    """
    seen: set[str] = set()
    above: dict[str, float] = {}

    def of(texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), FLOOR)
        held: list[tuple[int, set[str]]] = []
        fresh: set[str] = set()

        def settle() -> None:
            asked = sorted(fresh)
            above.update((t, m) for t, m in zip(asked, token_margins(asked, gains, offset), strict=True) if m > FLOOR)
            seen.update(asked)
            for row, tokens in held:
                out[row] = max((above[t] for t in tokens if t in above), default=FLOOR)
            held.clear()
            fresh.clear()
            if len(seen) > CACHED_WORDS:
                seen.clear()
                above.clear()

        for row, text in enumerate(texts):
            tokens = tokens_of(text)
            fresh |= tokens - seen
            held.append((row, tokens))
            if len(fresh) > 20_000 or len(held) > 500:
                settle()
        settle()
        return out

    return of


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """A linear SVM with squared hinge loss, by accelerated gradient descent; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    ahead, pace = w.copy(), 1.0
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + penalty)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        slope = -2 * x.T @ (weight * slack * y) + penalty * ahead
        new = ahead - step * slope
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    return w


def _fold(landmarks: np.ndarray, root: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    return (landmarks.T @ (root @ w[:-1])).astype(np.float64), -float(w[-1])


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of a margin, by damped Newton steps."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-6 * w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return max(float(w[0]), 1e-3), float(w[1])


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled documents outside the held-out fold; ``None`` if they aren't of both classes.

    A document, or a text, labelled in several ways counts as toxic.  NULL labels are passed over.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = kept(sampled(known.filter(~held_out(F.col("doc_id"))), TRAIN_DOCS), "toxic-labels")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = kept(texts.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for token in tokens_of(t) for w in windows_of(token) if len(w) > 2}) for t in texts_of(batch.column("text"))]
            print_ = [_print(ws) for ws in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(print_, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["toxic", "print", "words"]
            )

    docs = texts.select("toxic", "text").mapInArrow(parsed, "toxic int, print long, words array<string>").groupBy("print", "toxic").agg(F.min("words").alias("words"))
    docs = kept(docs, "toxic-words")
    totals = {r.toxic: r.n for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return None
    counted = docs.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("good")
    )
    counted = kept(counted, "toxic-counts")
    base = bad / (bad + good)
    total = F.col("bad") + F.col("good")
    surprise = (F.col("bad") - base * total) / F.sqrt(total * base * (1 - base) + 0.5)
    cut = docs.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda w: _pieces(w))))).alias("piece"))
    telling = (
        cut.groupBy("piece")
        .agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("good"))
        .withColumn("surprise", surprise)
        .filter((F.col("bad") >= max(3, bad // 100)) & (F.col("bad") > 0.6 * total) & (F.col("surprise") > 4))
        .orderBy(F.desc("surprise"), "piece").limit(4 * WITNESSES)
    )
    holding = (
        counted.filter("bad > 2 * good").select("word", "bad", F.explode(_pieces(F.col("word"))).alias("piece"))
        .join(F.broadcast(telling.select("piece", "surprise")), "piece")
        .groupBy("word").agg(F.first("bad").alias("bad"), F.max("surprise").alias("surprise"))
    )
    witnesses = holding.orderBy(F.desc("surprise"), F.desc("bad"), "word").limit(WITNESSES).collect()
    if not witnesses:
        witnesses = counted.withColumn("surprise", surprise).orderBy(F.desc("surprise"), "word").limit(8).collect()
    clean = [r.word for r in counted.filter("good > 0 and bad <= good").orderBy(F.xxhash64("word"), "word").limit(COUNTEREXAMPLES).collect()]
    toxic = [r.word for r in witnesses]
    mass = np.array([float(r.bad) for r in witnesses])
    landmarks = _features(toxic[: LANDMARKS // 2] + clean[: LANDMARKS // 2])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    used = values > 1e-4
    root = vectors[:, used] / np.sqrt(values[used])

    def mapped(words: list[str]) -> np.ndarray:
        parts = [(_features(words[i : i + 500]) @ landmarks.T) @ root for i in range(0, len(words), 500)]
        return np.concatenate([np.concatenate(parts), np.ones((len(words), 1))], axis=1)

    def fitted(negatives: list[str]) -> tuple[np.ndarray, float]:
        bad_ = toxic + [_with_letters(w) for w in toxic]
        x = np.concatenate([mapped(bad_), mapped(negatives)])
        y = np.repeat([1.0, -1.0], [len(bad_), len(negatives)])
        weight = np.concatenate([np.tile(mass / mass.sum() / 2, 2), np.full(len(negatives), 2 / len(negatives))])
        return _fold(landmarks, root, _svm(x, y, weight))

    gains, offset = fitted(clean)
    for _ in range(2):
        hard = _hardest(counted, gains, offset)
        clean = sorted({*clean, *hard})
        gains, offset = fitted(clean)
    marked = texts.select("toxic", "text").mapInArrow(_margin_rows(gains, offset), "toxic int, margin double").toPandas().sort_values(["toxic", "margin"])
    return Model(gains, offset, _curve(marked["margin"].to_numpy(), marked["toxic"].to_numpy()))


def _pieces(word: Column) -> Column:
    """The five-letter pieces of a word, its start marked."""
    marked = F.concat(F.lit("^"), word)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (PIECE - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(PIECE)))


def _with_letters(word: str) -> str:
    """A word with two letters put in, at a third and two thirds of it, chosen by its hash."""
    a, b = len(word) // 3, 2 * len(word) // 3
    h = hash_of(word)
    return word[:a] + chr(97 + h % 26) + word[a:b] + chr(97 + h // 26 % 26) + word[b:]


def _print(words: list[str]) -> int:
    """The smallest hash of the long words, which near copies share, so that they count once; of few long words the hash of all."""
    long = [w for w in words if len(w) > 8]
    return min(map(hash_of, long)) if len(long) > 4 else hash_of(" ".join(words))


def hash_of(word: str) -> int:
    """A 63-bit hash that every worker agrees on."""
    value = 1469598103934665603
    for byte in word.encode():
        value = ((value ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (value ^ (value >> 29)) & 0x7FFFFFFFFFFFFFFF


def _hardest(counted: DataFrame, gains: np.ndarray, offset: float, most: int = 1000) -> list[str]:
    """The words of clean documents that the model takes for the most toxic."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(token_margins(words, gains, offset), pa.float64())], names=["word", "margin"])

    clean = counted.filter("good > 0 and bad <= good").select("word").mapInArrow(scored, "word string, margin double")
    return [r.word for r in clean.orderBy(F.desc("margin"), "word").limit(most).collect()]


def _margin_rows(gains: np.ndarray, offset: float) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _document_margins(gains, offset)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(of(texts_of(batch.column("text"))), pa.float64())], names=["toxic", "margin"])

    return rows


def scored(documents: DataFrame, model: Model | None, name: str = "toxic_score") -> DataFrame:
    """``documents`` with a column ``name`` between 0 and 1, for every row and its whole text (NULL: empty).

    Without a model (no labels of both classes) every score is 0.  A column of that name is replaced.
    """
    if model is None:
        return documents.withColumn(name, F.lit(0.0))
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learnt = shared.value
        of = _document_margins(learnt.gains, learnt.offset)
        for texts in parts:
            yield pd.Series(learnt.score(of([t or "" for t in texts])))

    return documents.withColumn(name, score(F.col("text").cast("string")))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with their columns as they were."""
    name = max(["toxic_score", *documents.columns], key=len) + "_"
    return scored(documents, train(documents, labels), name).filter(F.col(name) < 0.5).select(documents.columns)
