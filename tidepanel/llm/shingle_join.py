"""Documents whose word shingles overlap: T-occurrence search over inverted lists, and linked components.

Two documents link when the Jaccard similarity of their sets of distinct word shingles is at
least a threshold: ``WIDTH`` words and ``SIMILAR`` percent unless the caller says otherwise.  Texts with one and the same set are one node, so copies cost one row each; sets, like
shingles, are told apart by 64-bit hashes.

1. Every node posts the first ``n - ceil(t n) + 1`` shingles (t the threshold) of its set in hash order.  Two
   linked sets share one of them at least.
2. Lists are split by bands of set sizes; a set also stands in lower bands that sets of it may link with lie in.
   Nodes of one list are compared in blocks by their sizes and by parity bitmaps of their
   sets, as wide as the band needs, which bound the distance of a pair from below.  Pairs that may link are joined up inside the task, so
   a block passes on a forest, never its pairs.  The components of all forests hold every link.
3. Each such component is searched, cut into bins if it is large: its sets become inverted lists, every node
   is a query over the bin's inverted lists, which are made once, and DivideSkip heap-merges the short lists and
   binary-probes the long ones for what the short ones left.  Nodes already connected are not searched against each other.
4. The links found give the components.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import byte_chunks, kept
from tidepanel.llm.components import components
from tidepanel.llm.hashing import mixed, word_bounds, word_hashes

#: Words of a shingle.
WIDTH = 3
#: Similarity in percent: a link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 90
#: Bits of the bitmaps of small sets at least.
BITMAP_BITS = 256
#: Each band of set sizes reaches this many times as far as the one before.
BAND = 1.5
#: Nodes of one shingle that one task compares with each other.
BLOCK = 2048
#: At most so many 8-byte ids are broadcast; beyond, the texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Shingles of the sets that one bin holds.
BIN_TOKENS = 1_000_000
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def overlap_needed(a, b, similar: int = SIMILAR):
    """The least intersection of two linked sets of ``a`` and ``b`` shingles (whole numbers or arrays)."""
    return -(-(similar * (a + b)) // (100 + similar))


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    return n - -(-similar * n // 100) + 1 if n else 0


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts of fewer words have one shingle, wordless ones none."""
    factors = np.concatenate((_FACTORS, mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)))[:width]
    for _, raw, offsets in byte_chunks(column):
        starts, ends, counts = word_bounds(raw, offsets)
        words = word_hashes(raw, starts, ends)
        grams = np.zeros(0, np.uint64)
        if len(words) >= width:
            last = len(words) - width + 1
            grams = words[:last] * factors[0]
            for i in range(1, width):
                grams += words[i : i + last] * factors[i]
            grams = mixed(grams)
        at = 0
        for count in counts:
            if count >= width:
                found = np.sort(grams[at : at + count - width + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif count:
                yield mixed(np.array([np.bitwise_xor.reduce(words[at : at + count] * np.arange(3, 3 + 2 * count, 2, dtype=np.uint64)) + np.uint64(count)]))
            else:
                yield np.zeros(0, np.uint64)
            at += count


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


BOUNDS = [*dict.fromkeys(math.ceil(BAND**k) for k in range(80))]


def band(n: int) -> int:
    """The band of a set's size: ``BOUNDS[band(n)] <= n < BOUNDS[band(n) + 1]``."""
    return bisect.bisect_right(BOUNDS, n) - 1


@functools.cache
def bits_of_band(kind: int, similar: int = SIMILAR) -> int:
    """Bits that tell unlike sets of this band's lists apart: what they differ in lies six deviations above what linked ones may."""
    largest = (BOUNDS[kind + 1] - 1) * 100 // similar
    far = 2 * largest - 2 * overlap_needed(largest, largest, similar)
    bits = BITMAP_BITS
    while bits / 2 - far < 3 * math.sqrt(bits):
        bits *= 2
    return bits


def bitmap_of(found: np.ndarray, bits: int) -> bytes:
    parity = np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def bitmaps_of(found: np.ndarray, similar: int = SIMILAR) -> list[dict]:
    """Bitmaps for the set's own band and for each band of smaller sets that it may link with.

    Of two linked sets both have one for the band of the smaller one.
    """
    n = len(found)
    return [{"kind": k, "bits": bitmap_of(found, bits_of_band(k, similar))} for k in range(band(-(-similar * n // 100)), band(n) + 1)]


_PROFILE = "doc_id long, n_shingles long, node long, prefix array<long>, bitmaps array<struct<kind:int,bits:binary>>"
_BITMAPS = pa.list_(pa.struct([("kind", pa.int32()), ("bits", pa.binary())]))


def _profiles(batches: Iterator[pa.RecordBatch], width: int, similar: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, prefixes, bitmaps = [], [], [], []
        for found in shingle_sets(batch.column("text"), width):
            sizes.append(len(found))
            nodes.append(node_of(found) if len(found) else None)
            prefixes.append(found[: prefix_length(len(found), similar)].view(np.int64))
            bitmaps.append(bitmaps_of(found, similar) if len(found) else [])
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
        flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(bitmaps, _BITMAPS)],
            names=["doc_id", "n_shingles", "node", "prefix", "bitmaps"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    def out(nodes: list[int], packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], names=["set", "shingles"])

    for batch in batches:
        nodes, packed, size = [], [], 0
        for found in shingle_sets(batch.column("text"), width):
            nodes.append(node_of(found))
            packed.append(found.tobytes())
            size += len(packed[-1])
            if size > 8 << 20:
                yield out(nodes, packed)
                nodes, packed, size = [], [], 0
        yield out(nodes, packed)


class InvertedLists:
    """For each shingle of a bin the places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.ones(len(flat), bool)
        first[1:] = flat[1:] != flat[:-1]
        self.owners = owners[order]
        self.starts = np.append(np.flatnonzero(first), len(flat))
        # The lists of each set, in the order of its shingles.
        lists = np.empty(len(flat), np.int64)
        lists[order] = np.cumsum(first) - 1
        self.of = np.split(lists, np.cumsum([len(s) for s in sets])[:-1])

    def search(self, query: int, wanted: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which sets share ``need`` shingles with the set ``query``; ``wanted`` marks the sets that are asked for, ``need`` is at least 1.

        With T the least need, the L longest lists are set aside; what occurs fewer than T - L times
        on the others cannot reach T.  The short lists are merged through a heap, which skips sets
        that aren't asked for, and the long ones are probed by binary search for what is left.
        """
        lists = self.of[query]
        lengths = self.starts[lists + 1] - self.starts[lists]
        least = int(need[wanted].min())
        longest = max(0, min(least - 1, len(lists) - 1))
        order = lists[np.argsort(lengths, kind="stable")]
        short, long = order[: len(lists) - longest], order[len(lists) - longest :]
        runs = [self.owners[self.starts[i] : self.starts[i + 1]] for i in short]
        runs = [run[wanted[run]] for run in runs]
        counts = np.zeros(len(self.of), np.int64)
        for owner in heapq.merge(*[run.tolist() for run in runs if len(run)]):
            counts[owner] += 1
        left = np.flatnonzero(counts >= max(1, least - longest))
        if not len(left):
            return left
        for i in long:
            run = self.owners[self.starts[i] : self.starts[i + 1]]
            place = np.searchsorted(run, left)
            place[place == len(run)] = 0
            counts[left] += run[place] == left
        return left[counts[left] >= need[left]]


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Which candidate sets share ``need`` elements with ``query`` (all sets sorted, ``need`` at least 1)."""
    wanted = np.arange(len(candidates) + 1) > 0
    reached = np.zeros(len(candidates), bool)
    reached[InvertedLists([query, *candidates]).search(0, wanted, np.append(1, need)) - 1] = True
    return reached


def _links_of(a: pa.Array | list, b: pa.Array | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def connected(nodes: list[int], sets: list[np.ndarray], sides: list[int], similar: int = SIMILAR) -> list[tuple[int, int]]:
    """Links that connect what is linked among the nodes of one bin; ``sides`` 0 and 1 are searched against each other, 2 against all."""
    label = np.arange(len(nodes))
    size = np.array([len(s) for s in sets])
    side = np.array(sides)
    lists = InvertedLists(sets)
    later = np.ones(len(nodes), bool)
    out = []
    for i in np.argsort(-size, kind="stable"):
        # Sets searched before are at least as large and have found this one.
        later[i] = False
        need = overlap_needed(size[i], size, similar)
        wanted = later & (label != label[i]) & ((side != side[i]) | (side == 2)) & (size >= need)
        if not wanted.any():
            continue
        for j in lists.search(i, wanted, need):
            out.append((nodes[i], nodes[j]))
            if label[i] != label[j]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return out


def _search(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows of one bin (group, i, j)."""
    run, held = None, {}

    def found() -> pa.RecordBatch:
        sides = [2 if run[1] == run[2] else int(h[1] == run[2]) for h in held.values()]
        links = connected(list(held), [h[0] for h in held.values()], sides, similar) if len(held) > 1 else []
        return _links_of([x for x, _ in links], [y for _, y in links])

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("group", "i", "j", "node", "block")]
        for group, i, j, node, block, packed in zip(*keys, batch.column("shingles"), strict=True):
            if (group, i, j) != run:
                if held:
                    yield found()
                run, held = (group, i, j), {}
            held[node] = (np.frombuffer(packed.as_buffer(), np.uint64).copy(), block)
    if held:
        yield found()


def searched(groups: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each group of ``groups`` (node, component).

    Sets are made again from the texts of the nodes in ``groups`` alone and each travels once to every bin that needs it.
    """
    sized = groups.join(nodes.select("node", "rep", "n_shingles"), "node")
    totals = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BIN_TOKENS).cast("int").alias("blocks"))
    members = kept(
        sized.join(totals, "component").select("rep", "node", F.col("component").alias("group"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members"
    )
    needed = members.select("rep").distinct()
    if members.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    sets = texts.join(needed, texts.doc_id.eqNullSafe(needed.rep), "left_semi").select("text").mapInArrow(partial(_sets, width=width), "set long, shingles binary")
    bins = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "group", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    rows = bins.join(sets, bins.node == sets["set"]).select("group", "i", "j", "node", "block", "shingles")
    return kept(rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(partial(_search, similar=similar), "a long, b long").distinct(), "links")


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _forest(key: np.ndarray, label: np.ndarray, node: np.ndarray, size: np.ndarray, side: np.ndarray, bits: np.ndarray, similar: int) -> tuple[list, list]:
    """Pairs that may link and join up what may be linked, within runs of equal rows of ``key``; ``side`` 2 pairs with all, others across."""
    n = len(node)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    runs = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], n)[runs]
    parent = np.arange(n)
    a_out, b_out = [], []
    rows, shift = np.arange(n), 1
    while True:
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            return a_out, b_out
        a, b = rows, rows + shift
        keep = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 2)) & (node[a] != node[b])
        a, b = a[keep], b[keep]
        total = size[a] + size[b]
        need = overlap_needed(size[a], size[b], similar)
        keep = np.minimum(size[a], size[b]) >= need
        a, b, far = a[keep], b[keep], (total - 2 * need)[keep]
        keep = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= far
        for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            p, q = _root(parent, label[x]), _root(parent, label[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                a_out.append(int(node[x]))
                b_out.append(int(node[y]))
        if keep.any():
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
        shift += 1


def _presumed(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Forests of the pairs that may link, of rows sorted by (kind, token, i, j)."""
    rest: pa.Table | None = None

    def forests(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds):
            part = table.filter(pa.array(kinds == kind))
            key = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("token", "i", "j")], axis=1)
            side = np.where(key[:, 1] == key[:, 2], 2, part.column("block").to_numpy() == key[:, 2])
            yield _links_of(*_forest(key, np.arange(len(key)), part.column("node").to_numpy(), part.column("n_shingles").to_numpy(), side, _bytes_matrix(part.column("bits").combine_chunks()), similar))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("kind", "token", "i", "j")], axis=1)
        last = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from forests(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield from forests(rest)


def linked(documents: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """One row per document: its id, the size of its shingle set and its component.

    Shingles have ``width`` words; a link needs a similarity of ``similar`` percent.
    ``component_id`` is the smallest id among the documents reachable by links, the document's own
    included.  NULL and wordless texts have no shingles and stand alone.  A row that repeats an id
    counts as a document of its own; rows without an id join components but never name one that has ids.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = kept(texts.mapInArrow(partial(_profiles, width=width, similar=similar), _PROFILE), "profiles")
    facts = F.first(F.struct("n_shingles", "prefix", "bitmaps")).alias("of")
    nodes = kept(profiles.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), facts).select("node", "rep", "of.*"), "nodes")
    banded = nodes.select("node", "prefix", F.explode("bitmaps.kind").alias("kind"))
    banded = banded.select("node", "kind", F.explode("prefix").alias("token"))
    posted = banded.select("node", "kind", F.xxhash64("token", "kind").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("listed")).filter("listed > 1")
    blocks = F.ceil(F.col("listed") / BLOCK).cast("int")
    lists = (
        posted.join(shared, "token").select("token", "kind", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", "kind", "node", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    )
    bitmaps = nodes.select("node", "n_shingles", F.explode("bitmaps").alias("b")).select("node", "n_shingles", "b.kind", "b.bits")
    presumed = (
        lists.join(bitmaps, ["node", "kind"])
        .repartition("kind", "token", "i", "j").sortWithinPartitions("kind", "token", "i", "j")
        .select("kind", "token", "i", "j", "block", "node", "n_shingles", "bits")
        .mapInArrow(partial(_presumed, similar=similar), "a long, b long")
        .distinct()
    )
    links = searched(kept(components(presumed), "groups"), nodes, texts, width, similar)
    found = components(links)

    named = (
        nodes.join(found, "node", "left")
        .select("node", "rep", F.coalesce("component", "node").alias("component"))
    )
    first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(first, "component").select("node", "component_id")
    return profiles.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(documents: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns as they were.

    Documents that link with nothing stay, wordless ones included.  Of rows that repeat an id one stays; rows
    without an id stay.
    """
    chosen = linked(documents, width, similar).filter("doc_id = component_id").select("doc_id").distinct()
    rows = documents.filter("doc_id is not null").join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.select(documents.columns).unionByName(documents.filter("doc_id is null"))
