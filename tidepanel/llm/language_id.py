"""Language of a text by interpolated Kneser-Ney models over its characters, one per language.

Letters are lower-cased, everything between two words becomes one space, and a text begins
after spaces.  The four-character windows of all training documents are counted by Spark; a
shorter sequence counts as often as different characters precede it.  Each language's model
is a few arrays sorted by hash: the log probability of every sequence kept, and the log
weight with which a context falls back to a shorter one.  The language of the lowest
cross-entropy per character is predicted.  Its score is a logistic regression on a
calibration fold, which also sets the limits beyond which a prediction is not ``accepted``.

``MODEL_GRAMS`` bounds the entries of each order over all languages that are broadcast (the most
frequent).  The others stay in a table, and a bitmap of their hashes is broadcast: windows that may
need one of them are joined to that table, so every text is judged by all entries.
``CALIBRATION`` bounds the documents that the scores are fitted on.  Counts cover all training documents.

Odd rows: a text that is NULL or has no letter is ``und`` with score 0 and not accepted, as
is everything where no document has a language.  A NULL doc_id is never learnt from and
counts as held out.  Of equal cross-entropies the language first in order wins.  Repeated
rows are judged alike.  Columns other than doc_id, text and lang are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import kept, sampled
from tidepanel.llm.hashing import mixed

#: Characters of a window.
ORDER = 4
#: One of this many folds is never learnt from, and which one it is; one of so many others calibrates.
FOLDS, HELD_OUT, CALIBRATING = 4, 2, 16
#: Entries broadcast of each order, documents that calibrate, and windows that a task holds before it sends their counts on.
MODEL_GRAMS, CALIBRATION, LOCAL = 1_000_000, 5_000, 1_500_000
#: Bits (as a power of two) of the bitmap of the entries of an order that are not broadcast.
BITMAP = 26
#: Characters that are read at once; a longer text is read by itself, as a whole.
CHUNK = 1 << 20
#: Accepted predictions of the calibration fold are right this often, and so many of its right ones stay below the ceiling of cross-entropy.
PRECISION, BELOW = 0.99, 0.999
UNKNOWN = "und"

_SPACE = np.uint32(32)
_FOLDED, _FOLDED_SIZE = 0xE000, 6400


# -- characters -----------------------------------------------------------------------------


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all characters of some texts, as 16 bits a character, and the text that each belongs to.

    Characters above 16 bits share the codes of the private area.
    """
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letter = _letters()[codes]
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1]
    # The first character after a word becomes a space, and texts end with a line break.
    stays = letter | after
    codes = np.where(letter, codes, _SPACE)[stays]
    owner = owner[stays]
    codes = np.where(codes > 0xFFFF, _FOLDED + codes % _FOLDED_SIZE, codes).astype(np.uint64)
    starts = np.searchsorted(owner, np.arange(len(texts)))
    place = np.arange(len(codes)) - starts[owner]
    key = codes.copy()
    for back in range(1, ORDER):
        earlier = np.full(len(codes), _SPACE, np.uint64)
        earlier[back:] = codes[:-back]
        earlier[place < back] = _SPACE
        key |= earlier << np.uint64(16 * back)
    return key, owner


def text_chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``CHUNK`` characters, with the index of the first."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, texts[first:]


# -- training -------------------------------------------------------------------------------


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learnt from; one without an id isn't."""
    return F.coalesce(fold(doc_id) % FOLDS == HELD_OUT, F.lit(True))


def calibrates(doc_id: Column) -> Column:
    return F.shiftrightunsigned(fold(doc_id), 2) % CALIBRATING == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        counts.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            for _, some in text_chunks([t for x, t in zip(langs, texts) if x == lang and t]):
                grams, n = np.unique(windows(some)[0], return_counts=True)
                if lang in counts:
                    before, many = counts[lang]
                    grams, at = np.unique(np.concatenate([before, grams]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([many, n])).astype(np.int64)
                counts[lang] = grams, n
            if sum(len(g) for g, _ in counts.values()) > LOCAL:
                yield from sent()
    yield from sent()


def _tables(learnt: DataFrame) -> dict[int, tuple[DataFrame, DataFrame, DataFrame]]:
    """Per order: sequences with their counts, contexts with the sum and number of what follows, and counts of counts."""
    counted = learnt.mapInArrow(_count, "lang string, gram long, n long")
    grams = kept(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "windows")
    out = {}
    for order in range(ORDER, 0, -1):
        contexts = grams.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
        rare = grams.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice"))
        out[order] = grams, contexts, rare
        if order > 1:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            grams = grams.groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return out


def _sorted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    hashes = mixed(keys)
    order = np.argsort(hashes)
    return hashes[order], *[v[order] for v in values]


def _find(hashes: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sought hashes, and whether they are there."""
    if not len(hashes):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.searchsorted(hashes, sought)
    at[at == len(hashes)] = 0
    return at, hashes[at] == sought


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return mixed(keys) >> np.uint64(64 - bits)


def _marked(bitmap: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(keys), bool)
    place = _place(keys, len(bitmap).bit_length() + 2)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


@dataclass
class Kneser:
    """One language's model: per order sorted hashes with log probabilities, and of contexts with log fallback weights."""

    alphabet: int
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    contexts: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def log_prob(self, windows: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last character of each window after those before it."""
        out = np.zeros(len(windows))
        open_, keys = np.arange(len(windows)), windows
        for n in range(order, 0, -1):
            if not len(open_):
                return out
            keys = keys & np.uint64((1 << 16 * n) - 1)
            at, there = _find(self.grams[n][0], mixed(keys))
            out[open_[there]] += self.grams[n][1][at[there]]
            open_, keys = open_[~there], keys[~there]
            at, there = _find(self.contexts[n][0], mixed(keys >> np.uint64(16)))
            out[open_[there]] += self.contexts[n][1][at[there]]
        out[open_] -= np.log(self.alphabet)
        return out

    def unsure(self, windows: np.ndarray, left: dict[tuple[int, bool], np.ndarray]) -> np.ndarray:
        """Whether the log probability of a window may take an entry that is only marked in the bitmaps ``left``."""
        out = np.zeros(len(windows), bool)
        open_, keys = np.arange(len(windows)), windows
        for n in range(ORDER, 0, -1):
            keys = keys & np.uint64((1 << 16 * n) - 1)
            there = _find(self.grams[n][0], mixed(keys))[1]
            open_, keys = open_[~there], keys[~there]
            outside = keys >> np.uint64(16)
            lacks = ~_find(self.contexts[n][0], mixed(outside))[1]
            out[open_] |= _marked(left.get((n, False)), keys) | (lacks & _marked(left.get((n, True)), outside))
        return out

    def add(self, n: int, grams: np.ndarray, counts: np.ndarray, contexts: np.ndarray, sums: np.ndarray, types: np.ndarray, discount: float) -> None:
        """The next order: discounted counts, interpolated with the order below."""
        hashes, sums, types = _sorted(contexts, sums, types)
        with np.errstate(divide="ignore"):
            self.contexts[n] = hashes, np.log(discount * types / sums)
        at, there = _find(hashes, mixed(grams >> np.uint64(16)))
        grams, counts, at = grams[there], counts[there], at[there]
        below = self.log_prob(grams, n - 1) if n > 1 else np.full(len(grams), -np.log(self.alphabet))
        prob = np.maximum(counts - discount, 0) / sums[at] + np.exp(self.contexts[n][1][at] + below)
        self.grams[n] = _sorted(grams, np.log(prob))


@dataclass
class Languages:
    """Models of all languages, weights of the score, and limits of acceptance.

    Where the models don't hold everything, ``entries`` does and ``left`` marks what they lack, per order for sequences and contexts.
    """

    models: dict[str, Kneser]
    left: dict[tuple[int, bool], np.ndarray] = field(default_factory=dict)
    entries: DataFrame | None = None
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.5, 0.0]))
    least: float = 0.5
    ceiling: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "entries": None}

    @staticmethod
    def ranked(costs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: index of the best language, its cross-entropy and the lead, from the costs in all languages and the windows."""
        costs = costs / np.maximum(n, 1)
        ranked = np.sort(costs, axis=0)
        return np.where(n > 0, costs.argmin(axis=0), -1), ranked[0], ranked[1] - ranked[0] if len(ranked) > 1 else np.ones(len(n))

    def measured(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk of texts: costs in all languages, windows, and the ends, keys and counts of each text's unsure windows, which cost nothing yet."""
        for _, some in text_chunks(texts):
            keys, owner = windows(some)
            distinct, at = np.unique(keys, return_inverse=True)
            unsure = np.any([model.unsure(distinct, self.left) for model in self.models.values()], axis=0)
            costs = np.stack([-np.bincount(owner, np.where(unsure, 0.0, model.log_prob(distinct))[at], minlength=len(some)) for model in self.models.values()])
            met, times = np.unique(owner[unsure[at]] * len(distinct) + at[unsure[at]], return_counts=True)
            ends = np.searchsorted(met, np.arange(len(some) + 1) * len(distinct))
            yield costs, np.bincount(owner, minlength=len(some)), ends, distinct[met % max(1, len(distinct))], times

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: index of the best language (-1: no letter), its cross-entropy, the lead over the next, the length."""
        best, entropy, lead, length = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not self.models:
            return best, entropy, lead, length
        for first, some in text_chunks(texts):
            keys, owner = windows(some)
            distinct, at = np.unique(keys, return_inverse=True)
            n = np.bincount(owner, minlength=len(some))
            costs = np.stack([-np.bincount(owner, model.log_prob(distinct)[at], minlength=len(some)) for model in self.models.values()])
            here = slice(first, first + len(some))
            best[here], entropy[here], lead[here] = self.ranked(costs, n)
            length[here] = n
        return best, entropy, lead, length

    @staticmethod
    def features(entropy: np.ndarray, lead: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(lead)), np.log(lead + 1e-4) + 3, np.log1p(length) - 3, entropy - 3], axis=1)

    def score(self, entropy: np.ndarray, lead: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(entropy, lead, length) @ self.weights, -30, 30)))

    def calibrate(self, right: np.ndarray, predicted: np.ndarray, entropy: np.ndarray, lead: np.ndarray, length: np.ndarray) -> None:
        """Fit the score and the limits to a calibration fold."""
        if len(right) == 0:
            return
        x, weights = self.features(entropy, lead, length), self.weights.copy()
        prior, stiff = self.weights.copy(), np.eye(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (p - right) + stiff @ (weights - prior)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + stiff, slope)
            weights = weights - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = weights
        scores = self.score(entropy, lead, length)
        order = np.argsort(-scores, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(right) + 1) >= PRECISION
        self.least = float(scores[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
        for i, lang in enumerate(self.models):
            good = entropy[(predicted == i) & (right > 0)]
            if len(good):
                self.ceiling[lang] = float(np.quantile(good, BELOW))


def _whole(tables: dict[int, tuple[DataFrame, DataFrame, DataFrame]], alphabet: int) -> Languages | None:
    """Models that hold all entries; None where an order may have more than ``MODEL_GRAMS``."""
    models: dict[str, Kneser] = {}
    for order in range(1, ORDER + 1):
        grams, contexts, rare = tables[order]
        discounts = {r.lang: (r.once or 0.5) / ((r.once or 0.5) + 2 * (r.twice or 0.5)) for r in rare.collect()}
        parts = []
        for frame in (grams, contexts):
            got = frame.orderBy(F.desc("n"), "lang", "gram").limit(MODEL_GRAMS).toArrow()
            if got.num_rows >= MODEL_GRAMS:
                return None
            lang = np.array(got.column("lang").to_pylist(), object)
            parts.append((lang, *[got.column(c).to_numpy() for c in got.column_names if c != "lang"]))
        for lang in sorted(discounts):
            (g, gram, n), (c, context, sums, types) = parts
            model = models.setdefault(lang, Kneser(alphabet))
            mine, outside = g == lang, c == lang
            model.add(order, gram[mine].view(np.uint64), n[mine], context[outside].view(np.uint64), sums[outside], types[outside], discounts[lang])
    return Languages(models)


def _entries(tables: dict[int, tuple[DataFrame, DataFrame, DataFrame]], alphabet: int) -> DataFrame:
    """All entries of all models: order, whether a context, lang, gram, n, and the log probability or weight."""
    parts, below = [], None
    for order in range(1, ORDER + 1):
        grams, contexts, rare = tables[order]
        once, twice = (F.when(F.col(c) == 0, 0.5).otherwise(F.col(c)) for c in ("once", "twice"))
        contexts = contexts.join(rare.select("lang", (once / (once + 2 * twice)).alias("discount")), "lang")
        contexts = contexts.withColumn("weight", F.col("discount") * F.col("types") / F.col("n"))
        after = contexts.select("lang", F.col("gram").alias("context"), F.col("n").alias("total"), "discount", "weight")
        found = grams.withColumn("context", F.shiftrightunsigned("gram", 16)).join(after, ["lang", "context"])
        if below is None:
            found = found.withColumn("below", F.lit(1 / alphabet))
        else:
            found = found.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))).join(below, ["lang", "shorter"])
        prob = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        probs = kept(found.select("lang", "gram", "n", prob.alias("prob")), "probabilities")
        below = probs.select("lang", F.col("gram").alias("shorter"), F.col("prob").alias("below"))
        for frame, context, value in ((probs, False, "prob"), (contexts, True, "weight")):
            parts.append(frame.select(F.lit(order).alias("order"), F.lit(context).alias("context"), "lang", "gram", "n", F.log(value).alias("value")))
    return kept(functools.reduce(DataFrame.unionByName, parts), "entries")


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of hashes of some grams, put together by Spark."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(0).to_numpy().view(np.uint64), bits).astype(np.int64) + 1)], names=["place"])

    marks = grams.select("gram").mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _bounded(tables: dict[int, tuple[DataFrame, DataFrame, DataFrame]], alphabet: int) -> Languages:
    """Models that hold the ``MODEL_GRAMS`` most frequent entries of each order, with the table of all and bitmaps of the others."""
    entries = _entries(tables, alphabet)
    models = {lang: Kneser(alphabet) for lang in sorted(r.lang for r in tables[1][2].select("lang").collect())}
    left = {}
    for order in range(1, ORDER + 1):
        for context in (False, True):
            frame = entries.where((F.col("order") == order) & (F.col("context") == context))
            got = frame.orderBy(F.desc("n"), "lang", "gram").limit(MODEL_GRAMS).select("lang", "gram", "n", "value").toArrow()
            lang = np.array(got.column("lang").to_pylist(), object)
            gram, value = got.column("gram").to_numpy().view(np.uint64), got.column("value").to_numpy()
            for name, model in models.items():
                (model.contexts if context else model.grams)[order] = _sorted(gram[lang == name], value[lang == name])
            if got.num_rows == MODEL_GRAMS:
                last = got.slice(MODEL_GRAMS - 1).to_pylist()[0]
                later = (F.col("lang") > last["lang"]) | ((F.col("lang") == last["lang"]) & (F.col("gram") > last["gram"]))
                left[order, context] = _bitmap(frame.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & later)), BITMAP)
    return Languages(models, left, entries)


def train(documents: DataFrame) -> Languages:
    """Models of the languages that ``lang`` names, from all documents outside the held-out and the calibration fold."""
    labelled = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    tables = _tables(labelled.where(~calibrates(F.col("doc_id"))).select("lang", "text"))
    alphabet = 1 + tables[1][0].agg(F.count_distinct("gram")).first()[0]
    languages = _whole(tables, alphabet) or _bounded(tables, alphabet)
    known = list(languages.models)
    tried = sampled(labelled.where(calibrates(F.col("doc_id"))), CALIBRATION)
    seen = _judged(tried, languages).where("best >= 0").collect()
    best = np.array([r.best for r in seen], np.int64)
    right = np.array([known[r.best] == r.lang for r in seen], float)
    languages.calibrate(right, best, *[np.array([r[c] for r in seen], float) for c in ("entropy", "lead", "length")])
    return languages


# -- prediction -----------------------------------------------------------------------------


def _looked_up(sought: DataFrame, languages: Languages) -> DataFrame:
    """window, lang and cost of every sought window in every language, by all entries."""
    alphabet = next(iter(languages.models.values())).alphabet
    entries = languages.entries.drop("n")
    places, names = [], {}
    for order in range(1, ORDER + 1):
        gram = F.col("window") if order == ORDER else F.col("window").bitwiseAND(F.lit((1 << 16 * order) - 1))
        for context, key in ((False, gram), (True, F.shiftrightunsigned(gram, 16))):
            if order > 1 or not context:
                places.append(F.struct(F.lit(order).alias("order"), F.lit(context).alias("context"), key.alias("gram")))
                names[order, context] = F.max(F.when((F.col("order") == order) & (F.col("context") == context), F.col("value"))).alias(f"{'c' if context else 'g'}{order}")
    found = sought.select("window", F.explode(F.array(*places)).alias("at")).select("window", "at.*").join(entries, ["order", "context", "gram"])
    found = found.groupBy("window", "lang").agg(*names.values())
    # The shortest context is one row of each language.
    first = entries.where((F.col("order") == 1) & F.col("context")).select("lang", F.col("value").alias("c1"))
    value = F.lit(-float(np.log(alphabet)))
    for order in range(1, ORDER + 1):
        value = F.coalesce(F.col(f"g{order}"), F.coalesce(F.col(f"c{order}"), F.lit(0.0)) + value)
    return sought.crossJoin(F.broadcast(first)).join(found, ["window", "lang"], "left").select("window", "lang", (-value).alias("cost"))


def _measured(rows: DataFrame, languages: Languages) -> DataFrame:
    """``rows`` with ``costs`` in all languages and ``length`` instead of the text; windows that the models may not tell are looked up."""
    shared = rows.sparkSession.sparkContext.broadcast(languages)
    carried = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*carried, "_row", "costs", "length", "windows", "times"]
        for batch in batches:
            at = 0
            for costs, length, ends, keys, times in shared.value.measured([t or "" for t in batch.column("text").to_pylist()]):
                here = batch.slice(at, len(length))
                at += len(length)
                costs = pa.ListArray.from_arrays(pa.array(np.arange(len(length) + 1) * len(costs), pa.int32()), pa.array(costs.T.ravel(), pa.float64()))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (keys.view(np.int64), times)]
                yield pa.RecordBatch.from_arrays([*[here.column(c) for c in [*carried, "_row"]], costs, pa.array(length), *lists], names=names)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text") + ", _row long, costs array<double>, length long, windows array<long>, times array<long>"
    met = kept(rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, schema), "measured")
    asked = met.select("_row", F.explode(F.arrays_zip("windows", "times")).alias("w")).select("_row", F.col("w.windows").alias("window"), F.col("w.times").alias("times"))
    costs = asked.join(_looked_up(asked.select("window").distinct(), languages), "window").groupBy("_row", "lang").agg(F.sum(F.col("times") * F.col("cost")).alias("cost"))
    more = costs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("lang", "cost"))).alias("more"))
    known = F.array(*map(F.lit, languages.models))
    total = F.transform("costs", lambda cost, i: cost + F.coalesce(F.element_at(F.col("more"), known[i]), F.lit(0.0)))
    return met.join(more, "_row", "left").select(*carried, total.alias("costs"), "length")


def _ready(rows: DataFrame, languages: Languages) -> DataFrame:
    return rows if languages.entries is None else _measured(rows, languages)


def _read(batch: pa.RecordBatch, languages: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``Languages.judged`` of a batch of texts or of their costs (``_ready``)."""
    if "text" in batch.schema.names:
        return languages.judged([t or "" for t in batch.column("text").to_pylist()])
    length = batch.column("length").to_numpy()
    return *languages.ranked(batch.column("costs").flatten().to_numpy().reshape(len(length), -1).T, length), length


def _judged(documents: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, lang, and what ``Languages.judged`` says of each text."""
    shared = documents.sparkSession.sparkContext.broadcast(languages)
    numbers = "best long, entropy double, lead double, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _read(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], names=["doc_id", "lang", "best", "entropy", "lead", "length"])

    return _ready(documents.select("doc_id", "lang", "text"), languages).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, lang string, {numbers}")


def predicted(documents: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, lang_pred, score, accepted and cross_entropy of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*shared.value.models, UNKNOWN], object)
        ceiling = np.array([shared.value.ceiling.get(k, np.inf) for k in known])
        for batch in batches:
            best, entropy, lead, length = _read(batch, shared.value)
            score = np.where(best >= 0, shared.value.score(entropy, lead, length), 0.0)
            accepted = (best >= 0) & (score >= shared.value.least) & (entropy <= ceiling[best])
            columns = [batch.column("doc_id"), pa.array(known[best].tolist(), pa.string()), pa.array(score), pa.array(accepted), pa.array(entropy)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted", "cross_entropy"])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean, cross_entropy double"
    return _ready(documents.select("doc_id", "text"), languages).mapInArrow(run, schema)
