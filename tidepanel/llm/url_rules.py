"""Allow and block rules on URLs by a range join over reversed hosts.

A host's labels are reversed (``m.example.net`` becomes ``net.example.m.``), so a rule on a host covers
one interval of keys: the host itself and all its subdomains.  URLs are range-partitioned and sorted by
their key, the rules are sorted too, and one sweep over both keeps a stack of the rules whose
interval is open.  As intervals of prefixes nest, the stack holds just the rules that fit a URL's host;
of those whose path fits as well, the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one sweep takes along, with every task; more are swept in as many rounds as it takes.
SWEPT_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """The labels of a host from the last to the first, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _sweep(rules: list[tuple[str, str, str]]):
    """A function over partitions sorted by key; ``rules``: (host, path, verdict)."""
    by_key: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, verdict in rules:
        by_key.setdefault(_key(host), []).append((host, path, verdict))
    ordered = sorted(by_key)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = 0, []
        for batch in batches:
            found = []
            for key, path, rule, host_chars, verdict in zip(*[batch[c] for c in ("_key", "path", "rule", "_host", "_verdict")], strict=True):
                while at < len(ordered) and ordered[at] <= key:
                    while stack and not ordered[at].startswith(stack[-1]):
                        stack.pop()
                    stack.append(ordered[at])
                    at += 1
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                fits = [r for open_ in stack for r in by_key[open_] if path.startswith(r[1])]
                if host_chars >= 0:  # what an earlier round found competes with the rest
                    fits.append((rule[:host_chars], rule[host_chars:], verdict))
                found.append(max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r), default=None))
            for name, value in (("rule", lambda r: r[0] + r[1]), ("_verdict", lambda r: r[2])):
                batch[name] = pd.Series([r and value(r) for r in found], dtype=object, index=batch.index)
            batch["_host"] = pd.Series([len(r[0]) if r else -1 for r in found], dtype="int64", index=batch.index)
            yield batch

    return sweep


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict ('allow' or 'block').  A rule fits its host and all subdomains if the
    page's path starts with the rule's; the longest one (host and path together, then the longer host, then by text)
    wins, whatever the number of rounds that the rules are swept in.  A page without a rule gets ``default``.  A NULL url, or one without ``://``, has an empty host and path.
    Repeated rules count once, repeated pages are rows of their own; other columns of ``pages`` are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # rule and verdict found so far, and the characters of the rule that are its host's (-1: none found)
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"_key": reversed_key(F.col("host")), "rule": none, "_host": F.lit(-1).cast("long"), "_verdict": none})
    listed = rules.select("host", "path", "verdict").filter("host is not null and path is not null").distinct()
    rounds = -(-listed.count() // SWEPT_RULES)
    # many pages of one host are dealt to several ranges, as the path and the id take part in the order
    rows = rows.repartitionByRange("_key", "path", "page_id").sortWithinPartitions("_key")
    for i in range(rounds):
        some = listed if rounds == 1 else listed.filter(F.pmod(F.xxhash64("host", "path"), F.lit(rounds)) == i)
        rows = rows.mapInPandas(_sweep([tuple(r) for r in some.collect()]), rows.schema)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
