"""Phrases whose words keep company, counted exactly in counting quotient filters.

Words are split off as in the contract: A-Z lower-cased, pieces end at ``.,;:!?`` and line
breaks, words at blanks and tabs.  Everything is per language.  A word that occurs at
least ``LEAST`` times in its language has an id; two or three ids beside each other in a
piece are packed into one integer and permuted by an invertible map.  The upper bits of the
result, its quotient, name a slot, the lower ones are kept as the remainder, so a filter
holds sorted, compact and lossless counters.  Each task builds filters of what it reads and
sends each stretch of quotients to one place, where the sorted filters are merged.

Ids are places in the sorted array of the words' 64-bit hashes, which is broadcast while it
holds at most ``DICTIONARY`` words.  Beyond that the hashes themselves are the ids and a
key has three words instead of one; nothing else changes.  The hashes of all words are
checked to be distinct, and drawn anew by another seed if they aren't.

Odd rows: a NULL text has no words; a NULL lang is the language ``und``.  Repeated rows
count as often as they occur, ids of documents are not read, other columns are left out.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import kept
from tidepanel.llm.hashing import mixed

#: A phrase must occur this often, and a longer one takes a phrase over at this percentage of it.
LEAST, COVERED = 10, 50
#: Words of the broadcast dictionary (8 bytes each).
DICTIONARY = 8_000_000
#: Distinct n-grams that a task collects before it sends its filters on.
LOCAL = 3_000_000
#: Tokens that are turned into n-grams at once.
CHUNK = 1 << 20
#: Occurrences that one stretch of quotients is meant for, and the number of stretches at most.
STRETCH, STRETCHES = 1 << 21, 1 << 20

_BREAK, _EMPTY = 0, 1
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# -- counting quotient filters --------------------------------------------------------------


class Permutation:
    """An invertible map of keys of ``bits`` bits each, a key being one or more such words."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64((bits + 1) // 2)
        self.inverses = [np.uint64(pow(m, -1, 1 << bits)) for m in _MIX]

    def _forward(self, x: np.ndarray) -> np.ndarray:
        for factor in _MIX:
            x = (x * np.uint64(factor)) & self.mask
            x = x ^ (x >> self.shift)
        return x

    def _back(self, x: np.ndarray) -> np.ndarray:
        for factor in reversed(self.inverses):
            x = x ^ (x >> self.shift)
            x = (x * factor) & self.mask
        return x

    def apply(self, keys: np.ndarray) -> np.ndarray:
        """Keys (words x n) permuted; with several words each is mixed into the first ones."""
        keys = np.stack([self._forward(k) for k in keys])
        for i in range(1, len(keys)):
            keys[0] ^= mixed(keys[i] + np.uint64(i)) & self.mask
        return keys

    def undo(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.copy()
        for i in range(1, len(keys)):
            keys[0] ^= mixed(keys[i] + np.uint64(i)) & self.mask
        return np.stack([self._back(k) for k in keys])


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (words x n) with the sums of their counts."""
    if keys.shape[1] == 0:
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = keys[:, order]
    fresh = np.ones(keys.shape[1], bool)
    fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    starts = np.flatnonzero(fresh)
    if counts is None:
        sums = np.diff(np.append(starts, keys.shape[1]))
    else:
        sums = np.add.reduceat(counts[order], starts)
    return keys[:, starts], sums.astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, bits: int, known: int) -> bytes:
    """A filter of sorted permuted keys as bytes; their first word has ``bits`` bits, of which the upper ``known`` are the same in all.

    The next upper bits are the quotient: of each slot only the number of its keys is
    written.  Of each key follow the bytes of its remainder, and its count in one byte, or
    in nine if it is 255 or more.
    """
    words, n = keys.shape
    q = max(0, min(bits - known, n.bit_length() - 1))
    rest = bits - known - q
    slots = ((keys[0] >> np.uint64(rest)) & np.uint64((1 << q) - 1)).astype(np.int64) if q else np.zeros(n, np.int64)
    sizes = np.bincount(slots, minlength=1 << q)
    wide = 1 if sizes.max(initial=0) < 256 else 4
    low = (keys[0] & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : (rest + 7) // 8]
    large = counts[counts >= 255]
    head = np.array([n, q, wide, len(large)], "<i8")
    parts = [head, sizes.astype(f"<u{wide}"), low, np.minimum(counts, 255).astype(np.uint8), large.astype("<i8"), *[k.astype("<u8") for k in keys[1:]]]
    return b"".join(part.tobytes() for part in parts)


def unpacked(data: bytes, bits: int, known: int, prefix: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of ``packed``; ``prefix`` are the upper bits left out."""
    n, q, wide, many = np.frombuffer(data, "<i8", 4).tolist()
    at = 32
    sizes = np.frombuffer(data, f"<u{wide}", 1 << q, at)
    at += wide << q
    rest = bits - known - q
    nb = (rest + 7) // 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :nb] = np.frombuffer(data, np.uint8, n * nb, at).reshape(n, nb)
    at += n * nb
    first = low.view("<u8").ravel()
    if q:
        first = first | (np.repeat(np.arange(1 << q, dtype=np.uint64), sizes) << np.uint64(rest))
    if known:
        first = first | np.uint64(prefix << (bits - known))
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(data, "<i8", many, at)
    at += 8 * many
    others = [np.frombuffer(data, "<u8", n, at + 8 * n * i) for i in range(words - 1)]
    return np.stack([first, *others]), counts


class Shard:
    """Counts of the n-grams of one task: a sorted part and what came since."""

    def __init__(self, words: int) -> None:
        self.keys, self.counts = np.zeros((words, 0), np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.pending += keys.shape[1]
        if self.pending >= LOCAL // 2:
            self.settle()

    def settle(self) -> None:
        if self.new:
            keys, counts = counted(np.concatenate(self.new, axis=1))
            self.new, self.pending = [], 0
            self.keys, self.counts = counted(np.concatenate([self.keys, keys], axis=1), np.concatenate([self.counts, counts]))


class Layout:
    """How ids become keys: all in one word while they fit, else one word each."""

    def __init__(self, dictionary: np.ndarray | None, stretches: int) -> None:
        self.dictionary = dictionary
        id_bits = 64 if dictionary is None else max(1, len(dictionary).bit_length())
        self.id_bits, self.known = id_bits, stretches.bit_length() - 1
        self.packs = {n: n * id_bits <= 63 for n in (2, 3)}
        # A packed key has at least as many bits as the stretches need.
        self.bits = {n: max(n * id_bits, self.known + 1) if self.packs[n] else 64 for n in (2, 3)}
        self.words = {n: 1 if self.packs[n] else n for n in (2, 3)}
        self.maps = {n: Permutation(self.bits[n]) for n in (2, 3)}

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of word hashes, and which are words that count."""
        if self.dictionary is None:
            return hashes, hashes > np.uint64(_EMPTY)
        if not len(self.dictionary):
            return hashes, np.zeros(len(hashes), bool)
        at = np.searchsorted(self.dictionary, hashes)
        at[at == len(self.dictionary)] = 0
        return at.astype(np.uint64), (self.dictionary[at] == hashes) & (hashes > np.uint64(_EMPTY))

    def grams(self, ids: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Permuted keys of all n-grams of a sequence of ids, breaks and rare words between them."""
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros((self.words[n], 0), np.uint64)
        whole = np.logical_and.reduce([counts[k : k + m] for k in range(n)])
        parts = [ids[k : k + m][whole] for k in range(n)]
        if self.packs[n]:
            key = parts[0]
            for part in parts[1:]:
                key = (key << np.uint64(self.id_bits)) | part
            parts = [key]
        return self.maps[n].apply(np.stack(parts))

    def hashes(self, keys: np.ndarray, n: int) -> list[np.ndarray]:
        """The word hashes of permuted keys, one array for each place in the n-gram."""
        keys = self.maps[n].undo(keys)
        if not self.packs[n]:
            return list(keys)
        mask = np.uint64((1 << self.id_bits) - 1)
        return [self.dictionary[((keys[0] >> np.uint64(self.id_bits * (n - 1 - k))) & mask).astype(np.int64)] for k in range(n)]


# -- Spark jobs -----------------------------------------------------------------------------


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def tokens(text: Column) -> Column:
    """Words of a text in order; a line break stands where a piece ends, and an empty one where blanks meet."""
    ends = ".,;:!?\n\x0b\x0c\r"
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ends, "abcdefghijklmnopqrstuvwxyz " + "\n" * len(ends))
    return F.split(F.concat(F.replace(lowered, F.lit("\n"), F.lit(" \n ")), F.lit(" \n")), " ")


def word_hash(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), lang, word)


def word_counts(documents: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, n, hash) of every word of every language, and the seed by which no two hashes are the same."""
    words = documents.select(language(F.col("lang")).alias("lang"), F.explode(tokens(F.col("text"))).alias("word")).where("word not in ('', '\n')")
    words = kept(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    for seed in range(1, 100):
        hashed = words.withColumn("hash", word_hash(F.col("lang"), F.col("word"), seed))
        clashing = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("words")).where(f"words > 1 or hash in ({_BREAK}, {_EMPTY})")
        if clashing.isEmpty():
            return hashed, seed
    raise ValueError("no seed tells all words apart")


def _filters(layout) -> object:
    """Batches of token hashes to filters, one row for each stretch of quotients."""

    def sent(shards: dict[int, Shard], layout: Layout) -> Iterator[pa.RecordBatch]:
        for n, shard in shards.items():
            shard.settle()
            keys, counts = shard.keys, shard.counts
            shift = np.uint64(layout.bits[n] - layout.known)
            stretch = (keys[0] >> shift).astype(np.int64) if layout.known else np.zeros(keys.shape[1], np.int64)
            names, starts = np.unique(stretch, return_index=True)
            ends = np.append(starts[1:], len(stretch))
            rows, size = [], 0
            for name, a, b in zip(names.tolist(), starts.tolist(), ends.tolist()):
                rows.append((n, name, packed(keys[:, a:b], counts[a:b], layout.bits[n], layout.known)))
                size += len(rows[-1][2])
                if size > 1 << 22:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)
            shard.keys, shard.counts = shard.keys[:, :0], shard.counts[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = layout.value
        shards = {n: Shard(plan.words[n]) for n in (2, 3)}
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            flat = flat[flat != np.uint64(_EMPTY)]
            for first in range(0, len(flat), CHUNK):
                ids, counts = plan.ids(flat[first : first + CHUNK + 2])
                for n, shard in shards.items():
                    # Every n-gram that begins in the chunk, and no other.
                    shard.add(plan.grams(ids[: CHUNK + n - 1], counts[: CHUNK + n - 1], n))
            if sum(s.keys.shape[1] for s in shards.values()) > LOCAL:
                yield from sent(shards, plan)
        yield from sent(shards, plan)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    n, stretch, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(stretch, pa.int64()), pa.array(data, pa.binary())], names=["n", "stretch", "filter"])


def phrase_counts(documents: DataFrame, words: DataFrame, seed: int, least: int = LEAST) -> DataFrame:
    """(n, h1, h2, h3, a) of all two- and three-word phrases that occur at least ``least`` times."""
    spark = documents.sparkSession
    size = words.agg(F.count(F.when(F.col("n") >= least, 1)).alias("frequent"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    dictionary = None
    if size["frequent"] <= DICTIONARY:
        found = words.where(F.col("n") >= least).select("hash").toArrow().column("hash").combine_chunks()
        dictionary = np.sort(found.to_numpy(zero_copy_only=False).view(np.uint64))
    wanted = max(1, -(-size["all"] // STRETCH))
    layout = spark.sparkContext.broadcast(Layout(dictionary, min(STRETCHES, 1 << (wanted - 1).bit_length())))
    lang = language(F.col("lang"))
    coded = F.transform(
        tokens(F.col("text")),
        lambda w: F.when(w == "", F.lit(_EMPTY).cast("long")).when(w == "\n", F.lit(_BREAK).cast("long")).otherwise(word_hash(F.col("lang"), w, seed)),
    )
    filters = documents.select(lang.alias("lang"), "text").select(coded.alias("hashes")).mapInArrow(_filters(layout), "n int, stretch long, filter binary")

    def merged(group: pa.Table) -> pa.Table:
        plan = layout.value
        n, stretch = group.column("n")[0].as_py(), group.column("stretch")[0].as_py()
        keys, counts = np.zeros((plan.words[n], 0), np.uint64), np.zeros(0, np.int64)
        waiting, size = [(keys, counts)], 0
        for data in group.column("filter"):
            waiting.append(unpacked(data.as_buffer().to_pybytes(), plan.bits[n], plan.known, stretch, plan.words[n]))
            size += waiting[-1][0].shape[1]
            if size > LOCAL:
                waiting, size = [counted(np.concatenate([k for k, _ in waiting], axis=1), np.concatenate([c for _, c in waiting]))], 0
        keys, counts = counted(np.concatenate([k for k, _ in waiting], axis=1), np.concatenate([c for _, c in waiting]))
        often = counts >= least
        hashes = [h.view(np.int64) for h in plan.hashes(keys[:, often], n)]
        hashes += [np.zeros(int(often.sum()), np.int64)] * (3 - n)
        return pa.table({"n": pa.array(np.full(len(hashes[0]), n, np.int32)), "h1": hashes[0], "h2": hashes[1], "h3": hashes[2], "a": counts[often]})

    return filters.groupBy("n", "stretch").applyInArrow(merged, "n int, h1 long, h2 long, h3 long, a long")


def scored_phrases(words: DataFrame, phrases: DataFrame, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate takes over.

    Every part of a candidate is at least as frequent as it, so it is among the words and phrases given.
    """
    word = words.where(F.col("n") >= least).select("hash", "lang", "word", F.col("n").alias("f"))

    def named(i: int) -> DataFrame:
        return word.select(F.col("hash").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))

    def score(a: str, left: str, right: str) -> Column:
        big = "cast({} as decimal(19, 0))"
        return F.expr(f"(cast({big.format(a)} * {big.format(a)} as decimal(32, 0)) * 1000000) div ({big.format(left)} * {big.format(right)})")

    pairs = phrases.where("n = 2").select("h1", "h2", "a")
    triples = phrases.where("n = 3").select("h1", "h2", "h3", "a")
    inside = triples.select("h1", "h2", "a").union(triples.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    free = pairs.join(inside, ["h1", "h2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    two = free.join(named(1), "h1").join(named(2), "h2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    three = (
        triples.join(pairs.select("h1", "h2", F.col("a").alias("front")), ["h1", "h2"])
        .join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("back")), ["h2", "h3"])
        .join(named(1), "h1").join(named(2).drop("f2"), "h2").join(named(3), "h3")
        .withColumns({"early": score("a", "f1", "back"), "late": score("a", "front", "f3")})
    )
    early = F.col("early") <= F.col("late")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("front")).alias("l"),
        F.when(early, F.col("back")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score"),
    )
    return two.union(three)


def mined(documents: DataFrame, least: int = LEAST, covered: int = COVERED) -> tuple[DataFrame, DataFrame]:
    """All scored phrases, and the number of word occurrences of each language."""
    words, seed = word_counts(documents)
    phrases = kept(phrase_counts(documents, words, seed, least), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return scored_phrases(words, phrases, least, covered), totals
