"""Benchmark passages in documents, found through a positional inverted index.

An item's windows are its runs of ten consecutive words, or the whole item if it has fewer.  The
index stores the postings (term, document, position) of terms in training documents.  A window is
looked up from its rarest terms: the posting lists of the two rarest are intersected with their
positions moved back by the term's offset, and what is left is intersected with the other terms'
lists in the documents left.  Everything is a DataFrame plan; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import kept

WINDOW = 10
#: At most so many distinct terms are broadcast to the postings; beyond, they are joined by shuffle.
BROADCAST_TERMS = 200_000

# A word is a run of what these characters are not; A-Z are lower-cased, nothing else.
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the end of a document among its postings; no word contains it.
_END = "\u0001"


def words(text: Column) -> Column:
    """The words of a text in order; none of NULL."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _BREAKS), lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, terms): every item's windows; repeated windows of an item once."""
    listed = benchmark.select("item_id", words(F.col("text")).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (width - 1), F.lit(1)))
    return listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, F.lit(width)))).alias("terms")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _tokens(documents: DataFrame) -> DataFrame:
    """(doc, pos, term) of every word, and a last row at the number of words."""
    return documents.select("doc", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(_END)))).alias("pos", "term"))


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of ``documents`` (doc, text) restricted to ``terms`` (term), with the rows that end documents."""
    ends = terms.sparkSession.range(1).select(F.lit(_END).alias("term"))
    return _tokens(documents).join(_small(kept(terms.unionByName(ends), "terms")), "term")


def frequencies(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, listed): how often each of ``terms`` stands in all documents."""
    return postings(documents, terms).groupBy("term").agg(F.count("*").alias("listed"))


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: 64 bits of id and text, so neither repeated nor missing ids mix rows up; equal rows share one."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def _counted_documents(documents: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id"), F.col("text")
    return documents.select(doc_id.cast("long").alias("doc_id"), row_key(doc_id, text).alias("doc"), text.cast("string").alias("text"))


def ranked_phrases(phrases: DataFrame, listed: DataFrame) -> DataFrame:
    """(phrase, rare): the terms of each phrase with their offsets, rarest first; phrases with a term nobody holds are left out."""
    places = phrases.select("phrase", F.size("terms").alias("width"), F.posexplode("terms").alias("offset", "term"))
    ranked = places.join(listed, "term").groupBy("phrase", "width").agg(F.array_sort(F.collect_list(F.struct("listed", "term", "offset"))).alias("rare"))
    return kept(ranked.filter(F.size("rare") == F.col("width")).select("phrase", "rare"), "ranked")


def phrase_matches(documents: DataFrame, ranked: DataFrame, index: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase, doc, start): where the phrases of ``ranked`` stand in ``documents`` (doc, text), from position 0.

    ``index`` holds the postings of their two rarest terms.  With ``slop`` every term may stand so many places away
    from where the start puts it: a proximity match.
    """
    near = F.sequence(F.lit(-slop), F.lit(slop))

    def starts(k: int) -> DataFrame:
        """Starts that the k-th rarest term allows."""
        place = F.col("rare")[k - 1]
        term = ranked.filter(F.size("rare") >= k).select("phrase", F.size("rare").alias("n"), place["term"].alias("term"), place["offset"].alias("offset"))
        moved = index.join(_small(term), "term").withColumn("start", F.col("pos") - F.col("offset"))
        if slop:
            moved = moved.withColumn("by", F.explode(near)).withColumn("start", F.col("start") + F.col("by")).drop("by").distinct()
        return moved.filter("start >= 0").select("phrase", "doc", "start", "n")

    first = starts(1)
    pair = first.filter("n > 1").join(starts(2).select("phrase", "doc", "start").distinct(), ["phrase", "doc", "start"], "left_semi")
    found = kept(first.filter("n = 1").unionByName(pair).distinct(), "starts")

    rest = ranked.filter("size(rare) > 2").select("phrase", F.explode(F.expr("slice(rare, 3, size(rare))")).alias("place")).select("phrase", "place.term", "place.offset")
    open_ = found.filter("n > 2")
    here = _small(open_.select("doc").distinct())
    local = documents.join(here, "doc", "left_semi")
    wanted = open_.join(_small(rest), "phrase").withColumn("pos", F.col("start") + F.col("offset"))
    if slop:
        wanted = wanted.withColumn("by", F.explode(near)).withColumn("pos", F.col("pos") + F.col("by")).drop("by")
    tokens = _tokens(local).withColumnRenamed("doc", "at")
    same = (wanted.doc == tokens["at"]) & (wanted.pos == tokens.pos) & (wanted.term == tokens.term)
    held = wanted.join(tokens, same).groupBy("phrase", "doc", "start").agg(F.count_distinct("offset").alias("met"), F.first("n").alias("n"))
    return found.filter("n <= 2").select("phrase", "doc", "start").unionByName(held.filter("met = n - 2").select("phrase", "doc", "start"))


def rare_index(documents: DataFrame, ranked: DataFrame) -> DataFrame:
    """The postings of the two rarest terms of every phrase, written to the shared folder."""
    terms = ranked.select(F.explode(F.slice("rare", 1, 2)).alias("place")).select("place.term").distinct()
    return kept(postings(documents, terms), "postings")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit.  NULL and empty texts have no words.  Every row is
    judged by its own text, whether its id is repeated or NULL.  An item id met twice with other texts has
    the windows of both.  Other columns are not read.
    """
    return _judged_rows(documents, benchmark).drop("doc")


def _judged_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    docs = _counted_documents(documents)
    phrases = windows(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    owners = kept(phrases.select("item_id", "terms", F.sha2(F.concat_ws(" ", "terms"), 256).alias("phrase")), "owners")
    phrases = kept(owners.select("phrase", "terms").dropDuplicates(["phrase"]), "windows")
    listed = kept(frequencies(docs, phrases.select(F.explode("terms").alias("term")).distinct()), "frequencies")
    ranked = ranked_phrases(phrases, listed)
    index = rare_index(docs, ranked)
    widths = phrases.select("phrase", F.size("terms").alias("width"))
    matches = kept(phrase_matches(docs, ranked, index).join(_small(widths), "phrase"), "matches")

    hits = (
        matches.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("width") - 1)).alias("pos"))
        .distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    )
    items = (
        matches.select("doc", "phrase").distinct().join(owners.select("phrase", "item_id"), "phrase").select("doc", "item_id").distinct()
        .groupBy("doc").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item_id"))).alias("items"))
    )
    # Equal rows end at the same place.
    sizes = index.filter(F.col("term") == _END).groupBy("doc").agg(F.max("pos").cast("long").alias("n_words"))
    found = sizes.join(hits, "doc", "left").join(items, "doc", "left")
    return docs.select("doc_id", "doc").join(found, "doc").select(
        "doc", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with their columns as they were."""
    bad = _judged_rows(documents, benchmark).filter("contaminated").select(F.col("doc").alias("_doc")).distinct()
    return documents.join(bad, row_key(F.col("doc_id"), F.col("text")) == bad["_doc"], "left_anti").select(documents.columns)
