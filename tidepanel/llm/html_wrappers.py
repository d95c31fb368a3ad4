"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts.  Tandem repeats are folded into repeated groups; pages of one host whose
containers then follow each other in the same way are one template.  The pages of a template are aligned into a wrapper,
a regular expression without unions, where texts that differ become slots.  The wrappers of a host's templates are
aligned container by container: a container that only some pages hold is optional, and so is a text in it that the others
lack; texts that stand in for each other are slots.  So the wrappers tell for every container whether its
text is fixed, optional or free, and which containers hold the article of the host's pages; tags and names only weigh in.
All pages of a host and all their tokens take part: every task folds its pages into one partial wrapper for each template, and
these are merged, in two rounds, as are a container's texts in the templates.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import kept
from tidepanel.llm.url_rules import host_of

#: Partial wrappers that a task holds before it passes them on, and groups that those of one template are first merged in.
HELD_WRAPPERS, MERGES = 2000, 32
#: The longest group of tokens looked at as a repeat.
REPEAT = 12
#: Wrappers are broadcast up to so many templates; beyond, pages are shuffled to them.
BROADCAST_TEMPLATES = 2000

#: How the tags weigh the text of a container when the article is chosen.
PRIOR = {"main": 4.0, "": 1.0, "boiler": 1 / 16}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_RAW = {"script", "style", "noscript", "template", "svg", "math", "textarea", "select", "option", "button", "iframe", "object", "canvas", "head", "title"}
_UNREAD = {"script", "style", "textarea", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"} | _RAW
_BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|sidebar\w*|"
    r"side|menu\w*|nav\w*|breadcrumbs?|toolbar|header|masthead|footer\w*|copyright|legal|comments?|commentlist|discussion|disqus|respond|replies|share|sharing|social|"
    r"related|recommend\w*|widget\w*|pagination|pager|login|signup|search\w*|form|navigation|complementary|contentinfo|search|skip\w*)(?:$|[\s_-])",
    re.I,
)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|main|content|post|entry|story|body)(?:$|[\s_-])", re.I)
#: Tags that end an open paragraph or item of their own kind.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('open', name, label), ('close', name, ''), ('text', raw text, ''); labels hold class, id and role."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if m[4] is not None:
            yield "text", m[4], ""
        elif m[2] is not None:
            name = m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            label = " ".join(v.strip("\"'") for _, v in _ATTRIBUTE.findall(m[3])) if m[3] else ""
            if m[3] and _HIDDEN.search(m[3]):
                label += " \0"
            yield "open", name, label
            if name in _UNREAD:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.start() if close else end


def walked(page: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """The texts of a page with the path of the containers around them; ('', path) where a block begins or ends."""
    path: list[str] = []
    names: list[str] = []
    for kind, value, label in tokens(page):
        if kind == "text":
            yield value, tuple(path)
        elif kind == "open":
            if value in _BLOCK:
                yield "", tuple(path)
            if value in _VOID:
                if value == "br":
                    yield " ", tuple(path)
                continue
            closes = _CLOSES.get(value) or ({"p"} if value in _BLOCK else set())
            while names and names[-1] in closes:
                names.pop()
                path.pop()
            names.append(value)
            path.append(f"{value} {label}" if label else value)
        else:
            if value in _BLOCK:
                yield "", tuple(path)
            if value in names:
                while names.pop() != value:
                    path.pop()
                path.pop()


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path without inline tags and paragraphs."""
    return tuple(p for p in path if (n := p.split(" ", 1)[0]) in _BLOCK - {"p", "li"} or n in _RAW or " " in p)


def judged(path: tuple[str, ...]) -> str:
    """By the tags alone: 'main', 'boiler' or '' (unclear).  The outermost article counts; what is boiler inside it stays boiler."""
    main = ""
    for part in path:
        name, _, label = part.partition(" ")
        if name in _BOILER_TAGS and not (name == "header" and main) or "\0" in label or (label and name not in ("html", "body", "main", "article") and _BOILER_NAMES.search(label)):
            return "boiler"
        if name in ("article", "main") or (label and _MAIN_NAMES.search(label)):
            main = "main"
    return main


def stream(page: str) -> list[str]:
    """Containers entered and texts met, as symbols to be aligned."""
    out: list[str] = []
    before = None
    for text, path in walked(page):
        if text.strip():
            at = "/".join(container(path))
            if at != before:
                out.append("<" + at)
                before = at
            out.append("=" + " ".join(html.unescape(text).split()))
    return out


def folded(symbols: list[str]) -> list[str]:
    """Tandem repeats of groups of symbols (texts alike) reduced to one group, marked '+'."""
    out = list(symbols)
    for size in range(1, REPEAT + 1):
        shape = ["=" if s[0] == "=" else s.lstrip("+") for s in out]
        kept_, i = [], 0
        while i < len(out):
            j = i + size
            while j + size <= len(out) and shape[j : j + size] == shape[i : i + size]:
                j += size
            if j > i + size:
                kept_ += [s if s[0] == "+" else "+" + s for s in out[i : i + size]]
                i = j
            else:
                kept_.append(out[i])
                i += 1
        out = kept_
    return out


def aligned(wrapper: list[str], page: list[str]) -> list[str]:
    """The wrapper that matches what it matched and ``page``: differing texts become slots ('#'), one-sided parts optional ('?').

    What differs in form is aligned by equal texts first, then between them by form alone.
    """

    def bare(s: str) -> str:
        s = s.lstrip("?+")
        return "#" if s[0] in "=#" else s

    def steps(i: int, j: int, k: int, m: int, texts: bool) -> Iterator[tuple[str, int, int, int, int]]:
        if a[i:j] == b[k:m]:
            yield "equal", i, j, k, m
            return
        if not texts and {*a[i:j], *b[k:m]} == {"#"}:  # one after the other, without a search of all pairs
            n = min(j - i, m - k)
            yield "equal", i, i + n, k, k + n
            yield "insert", i + n, j, k + n, m
            return
        x, y = ([s.lstrip("?+") for s in wrapper[i:j]], [s.lstrip("?+") for s in page[k:m]]) if texts else (a[i:j], b[k:m])
        for op, p, q, u, v in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if texts and op == "replace":
                yield from steps(i + p, i + q, k + u, k + v, False)
            else:
                yield op, i + p, i + q, k + u, k + v

    out: list[str] = []
    a, b = [bare(s) for s in wrapper], [bare(s) for s in page]
    for op, i, j, k, m in steps(0, len(a), 0, len(b), True):
        if op == "equal":
            for x, y in zip(wrapper[i:j], page[k:m], strict=True):
                marks = ("?" if "?" in x[: len(x) - len(x.lstrip("?+"))] else "") + ("+" if "+" in (x[0], y[0]) or x[:2] == "?+" else "")
                x_, y_ = x.lstrip("?+"), y.lstrip("?+")
                out.append(marks + (x_ if x_ == y_ else "#" if x_[0] in "=#" else x_))
        else:
            out += ["?" + s.lstrip("?") for s in wrapper[i:j] + page[k:m]]
    return out


def unseen(path: tuple[str, ...]) -> bool:
    """Whether a browser shows no text there."""
    return any(part.split(" ", 1)[0] in _RAW or "\0" in part for part in path)


def decided(found: dict[str, tuple[int, int, bool]]) -> dict[str, str]:
    """What a wrapper says about each container, 'main' or 'boiler'; {} without slots.

    ``found`` holds pages, letters and whether a text is a slot.  The article is the container with most text among those with
    slots; what is near it in size counts as well, and what lies inside it.  A container whose texts are all fixed on most pages
    is boilerplate, whatever its tags.  ``judged`` weighs sizes (``PRIOR``) and decides on small or rare containers only.
    """
    own = {at: judged(tuple(at.split("/"))) for at in found}
    score = {at: letters * PRIOR[own[at]] for at, (_, letters, slot) in found.items() if slot and not unseen(tuple(at.split("/")))}
    if not score:
        return {}
    top = max(score, key=lambda k: (score[k], k))
    said = {}
    for at, (pages, _, slot) in found.items():
        fixed = not slot and 2 * pages > found[top][0]
        near = at == top or score.get(at, 0) * 3 > score[top]
        prior = own[at] == "main" or (own[at] != "boiler" and at.startswith(top + "/"))
        said[at] = "main" if near or (prior and not fixed and not unseen(tuple(at.split("/")))) else "boiler"
    return said


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def profile(page: str) -> tuple[str, dict]:
    """A page's template and its partial wrapper: pages, symbols with repeats folded, letters of each container.

    The template is a digest of the symbols without their texts.  A text stands as a digest, a repeated one as that of all texts of its container.
    """
    symbols = stream(page)
    texts: dict[str, list[str]] = {}
    at = ""
    for s in symbols:
        if s[0] == "<":
            at = s[1:]
        else:
            texts.setdefault(at, []).append(s[1:])
    whole = {at: digest("\n".join(t)) for at, t in texts.items()}
    out = []
    for s in folded(symbols):
        if s.lstrip("+")[0] == "<":
            at = s.lstrip("+")[1:]
            out.append(s)
        else:
            out.append("+=" + whole[at] if s[0] == "+" else "=" + digest(s[1:]))
    shape = [s if s[0] == "<" else "=" for s in (s.lstrip("+") for s in out)]
    return digest(json.dumps(shape)), {"pages": 1, "symbols": out, "letters": {at: sum(map(len, t)) for at, t in texts.items()}}


def merged(one: dict, other: dict) -> dict:
    """Two partial wrappers of one template as one."""
    letters = {at: n + other["letters"][at] for at, n in one["letters"].items()}
    return {"pages": one["pages"] + other["pages"], "symbols": aligned(one["symbols"], other["symbols"]), "letters": letters}


def places_of(found: dict) -> Iterator[tuple[str, int, int, str]]:
    """(container, pages, letters, its texts as JSON or '#' if one of them is a slot) of a wrapper."""
    texts: dict[str, list[str]] = {}
    at = ""
    for symbol in found["symbols"]:
        s = symbol.lstrip("?+")
        if s[0] == "<":
            at = s[1:]
        else:
            texts.setdefault(at, []).append(symbol if s[0] == "=" else s)
    for at, t in texts.items():
        yield at, found["pages"], found["letters"][at], "#" if "#" in t else json.dumps(t)


def container_wrapper(met: Iterable[str]) -> str:
    """The wrapper of what templates hold in one container (``places_of``): '#' as soon as a text is a slot, else texts, some optional.

    Longer ones come first, so that the order of the rows doesn't matter.
    """
    whole: list[str] | None = None
    for texts in sorted(met, key=lambda t: (t != "#", -len(t), t)):
        if texts == "#":
            return "#"
        one = json.loads(texts)
        whole = one if whole is None else aligned(whole, one)
        if any(s.lstrip("?+") == "#" for s in whole):
            return "#"
    return json.dumps(whole)


def is_slot(at: str, texts: str) -> bool:
    """Whether a container's text is free: a slot, or where the tags say article a text that only some pages have."""
    return texts == "#" or (any("?" in s[: len(s) - len(s.lstrip("?+"))] for s in json.loads(texts)) and judged(tuple(at.split("/"))) == "main")


def wrapper_of(pages: list[str]) -> dict[str, str]:
    """What the wrapper of some pages of one host says about each container (``decided``)."""
    wrapper = folded(stream(pages[0])) if pages else []
    for page in pages[1:]:
        wrapper = aligned(wrapper, folded(stream(page)))
    at, slots = "", {}
    for symbol in wrapper:
        s = symbol.lstrip("?+")
        if s[0] == "<":
            at = s[1:]
        else:
            slots[at] = slots.get(at, False) or s == "#" or (len(pages) > 1 and symbol[0] in "?+")
    held: dict[str, int] = {}
    letters: dict[str, int] = {}
    for page in pages:
        met = set()
        for text, path in walked(page):
            if text.strip():
                key = "/".join(container(path))
                letters[key] = letters.get(key, 0) + len(text.strip())
                met.add(key)
        for key in met:
            held[key] = held.get(key, 0) + 1
    return decided({key: (held.get(key, 0), letters.get(key, 0), slot) for key, slot in slots.items()})


def main_text(page: str, wrapper: dict[str, str]) -> str:
    """The blocks of a page's article, white space made single, joined by newlines."""
    blocks: list[tuple[str, str]] = []
    held: list[str] = []
    known: dict[tuple[str, ...], str] = {}
    verdict = ""

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append((verdict, text))
        held.clear()

    for text, path in walked(page):
        if not text:
            close()
            continue
        at = known.get(path)
        if at is None:
            said = wrapper.get("/".join(container(path)))
            at = known[path] = judged(path) if said is None else said
        if at != verdict:
            close()
            verdict = at
        held.append(text)
    close()
    best = "main" if any(v == "main" for v, _ in blocks) else ""
    return "\n".join(text for v, text in blocks if v == best)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points).

    NULL or empty html has an empty text.  Pages without a host are one host.  Repeated rows are rows of their
    own; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], dict] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*key, json.dumps(found)) for key, found in held.items()], columns=["host", "template", "found"])

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                template, found = profile(page)
                key = (host, template)
                held[key] = merged(held[key], found) if key in held else found
            if len(held) > HELD_WRAPPERS:
                yield out()
                held.clear()
        yield out()

    def together(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for found in group["found"]:
            found = json.loads(found)
            whole = found if whole is None else merged(whole, found)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "template": [group["template"].iloc[0]], "found": [json.dumps(whole)]})

    def container_of(group: pd.DataFrame) -> pd.DataFrame:
        host, at = group["host"].iloc[0], group["at"].iloc[0]
        return pd.DataFrame({"host": [host], "at": [at], "pages": [group["pages"].sum()], "letters": [group["letters"].sum()], "texts": [container_wrapper(group["texts"])]})

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        found = {at: (n, letters, slot) for at, n, letters, slot in zip(group["at"], group["pages"], group["letters"], map(is_slot, group["at"], group["texts"]), strict=True)}
        return pd.DataFrame({"of": [group["host"].iloc[0]], "shape": [group["template"].iloc[0]], "wrapper": [json.dumps(decided(found))]})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, template, found in batch.itertuples(index=False):
                yield pd.DataFrame([(host, template, *place) for place in places_of(json.loads(found))], columns=["host", "template", "at", "pages", "letters", "texts"])

    fields = "host string, template string, found string"
    parts = kept(rows.select("host", "html").mapInPandas(partials, fields), "partial-wrappers")
    few = parts.withColumn("turn", F.pmod(F.xxhash64("found"), F.lit(MERGES))).groupBy("host", "template", "turn").applyInPandas(together, fields)
    templates = kept(few.groupBy("host", "template").applyInPandas(together, fields), "templates")
    places = templates.mapInPandas(spread, "host string, template string, at string, pages long, letters long, texts string")
    held = "host string, at string, pages long, letters long, texts string"
    apart = places.groupBy("host", "at", "texts").agg(F.sum("pages").alias("pages"), F.sum("letters").alias("letters"))
    some = apart.withColumn("turn", F.pmod(F.xxhash64("texts"), F.lit(MERGES))).groupBy("host", "at", "turn").applyInPandas(container_of, held)
    whole = some.groupBy("host", "at").applyInPandas(container_of, held)
    known = places.select("host", "template", "at").join(whole, ["host", "at"])
    wrappers = kept(known.groupBy("host", "template").applyInPandas(chosen, "of string, shape string, wrapper string"), "wrappers")
    if wrappers.count() <= BROADCAST_TEMPLATES:
        wrappers = F.broadcast(wrappers)
    shape = F.pandas_udf(lambda column: column.map(lambda page: profile(page)[0]), "string")
    shaped = rows.withColumn("template", shape("html"))
    joined = shaped.join(wrappers, (shaped.host == wrappers["of"]) & (shaped.template == wrappers["shape"]), "left").select("page_id", "url", "html", "wrapper")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, dict[str, str]] = {}
        for batch in batches:
            out = []
            for page, wrapper in zip(batch["html"], batch["wrapper"], strict=True):
                if wrapper not in read:
                    read.clear() if len(read) > 1000 else None
                    read[wrapper] = json.loads(wrapper) if wrapper else {}
                out.append(main_text(page, read[wrapper]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    return joined.mapInPandas(texts, "page_id long, url string, text string, n_chars long")
