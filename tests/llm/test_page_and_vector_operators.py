"""Operators on pages and vectors against brute force, and on odd rows."""

import numpy as np
from conftest import SF

from tidepanel.llm import html_wrappers, url_rules, vector_search
from tidepanel.llm.queries import QUERIES, table


def test_url_rules_nest(spark, monkeypatch):
    rules = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/y", "block"), ("b.a.net", "/", "allow"), ("net", "/", "block")]
    urls = [None, "", "a.net/x/", "http://a.net", "http://A.NET/x/1", "http://c.a.net/x/yes?q=/x/", "https://b.a.net/x/y", "http://xnet/", "http://a.net.org/x/", "ftp://net/z#f", "http://b.a.net/x/y"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = {3: None, 4: "a.net/x/", 5: "a.net/x/y", 6: "a.net/x/y", 9: "net/", 10: "a.net/x/y"}
    for swept in (50_000, 2):
        monkeypatch.setattr(url_rules, "SWEPT_RULES", swept)
        got = {r.page_id: r.rule for r in url_rules.judged(pages, frame).collect()}
        assert got == {i: want.get(i) for i in range(len(urls))}


def test_url_rules_in_many_rounds(spark, monkeypatch):
    """Rounds agree with one sweep: pages without a rule so far, and equally long rules of other hosts."""
    rules = [("a.bb", "/ccc", "block"), ("bb", "/ccc/d", "allow"), ("bb", "/", "block"), ("x.a.bb", "/", "allow"), ("cc", "/e", "block"), ("", "/", "allow")]
    urls = ["http://a.bb/ccc/d", "http://x.a.bb/ccc/d/e", "http://bb/ccc/d", "http://q.cc/e", "http://cc/f", "http://zz/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    once = sorted(map(tuple, url_rules.judged(pages, frame).collect()), key=repr)
    assert {r[0]: r[3] for r in once} == {0: "a.bb/ccc", 1: "a.bb/ccc", 2: "bb/ccc/d", 3: "cc/e", 4: None, 5: None, 6: None}
    for swept in (1, 3):
        monkeypatch.setattr(url_rules, "SWEPT_RULES", swept)
        assert sorted(map(tuple, url_rules.judged(pages, frame).collect()), key=repr) == once


def test_url_rules_on_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judged(pages, spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title {0}</h1><p>First &amp; <b>bold</b>  text {0}<p>Second<br>line</p><div class="ad">Buy</div>
<aside>See also</aside><form><input>Mail</form><section id="comments"><p>Nice!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_article_without_the_rest(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(4)] + [(9, None, None), (10, "x", ""), (11, "x", "<p>just <i>text"), (12, "x", "<<< a < b"), (0, "http://h.example/0", PAGE.format(0))]
    got = [(r.page_id, r.text, r.n_chars) for r in html_wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in got}
    assert texts[2] == "Title 2\nFirst & bold text 2\nSecond line"
    assert texts[9] == texts[10] == "" and texts[11] == "just text"
    assert all(n == len(t) for _, t, n in got)


def test_wrapper_finds_the_free_container():
    pages = [f"<body><div id=x>Same words on all pages</div><div id=y><p>{'free text ' * 30}{i}</p></div></body>" for i in range(5)]
    wrapper = html_wrappers.wrapper_of(pages)
    assert html_wrappers.main_text(pages[0], wrapper) == ("free text " * 30 + "0")


def test_wrapper_outweighs_tags():
    pages = [f"<body><article><h3>Subscribe now</h3></article><div id=y><p>{'free text ' * 30}{i}</p></div><article class=tip>Read our tips</article></body>" for i in range(5)]
    wrapper = html_wrappers.wrapper_of(pages)
    assert wrapper["body/article/h3"] == wrapper["body/article tip"] == "boiler" and wrapper["body/div y"] == "main"
    assert html_wrappers.main_text(pages[3], wrapper) == "free text " * 30 + "3"


def test_every_page_and_token_takes_part(spark):
    def page(kind, i):
        menu = "".join(f"<div class=m{k}>Go to {k}</div>" for k in range(3))
        return f"<body>{menu}<div id=t{kind}>Template {kind}</div><div id=a{kind}><p>{f'free {i} text ' * 40}</p></div></body>"

    # A host with more templates and pages than a small sample holds, and pages that go on after thousands of symbols.
    rows = [(i, f"http://h.example/{i}", page(i % 40, i)) for i in range(160)]
    long = "".join(f"<div class=x{k % 37}>a</div><table class=z{k % 41}><tr><td>b</table>" for k in range(1500))
    tail = "<div id=late><p>{0}</p></div>"
    rows += [(1000 + i, f"http://l.example/{i}", f"<body><div id=y>{f'lead {i} ' * 300}</div>{long}{tail.format(f'late {i} ' * 400)}</body>") for i in range(3)]
    got = {r.page_id: r.text for r in html_wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == f"free {i} text " * 39 + f"free {i} text" for i in range(160))
    assert all(got[1000 + i] == " ".join([f"lead {i}"] * 300) + "\n" + " ".join([f"late {i}"] * 400) for i in range(3))


def test_texts_of_unlike_pages_are_aligned(spark):
    """A large unnamed container with fixed texts of which some pages lack one is no article, however its pages follow each other."""
    parts = [f"<p>Terms part {k} {'and so on ' * (9 + k)}</p><div class=s{k}>x{k}</div>" for k in range(3)]

    def page(i):
        fixed = parts if i % 2 else parts[1:]
        return f"<body><div id=u>{''.join(fixed)}</div><div id=v><p>{f'words of {i} ' * 12}</p></div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: (f"words of {i} " * 12).strip() for i in range(8)}


def test_alignment_tells_optional_texts_from_slots():
    assert html_wrappers.aligned(["=a", "=b", "=c"], ["=b", "=c"]) == ["?=a", "=b", "=c"]
    assert html_wrappers.container_wrapper(['["=b", "=c"]', '["=a", "=b", "=c"]', '["=a", "=b"]']) == '["?=a", "=b", "?=c"]'
    assert html_wrappers.container_wrapper(['["=b", "=c"]', '["=a", "=b", "=d"]']) == "#"
    assert not html_wrappers.is_slot("body/div x", '["?=a", "=b"]') and html_wrappers.is_slot("body/article", '["?=a", "=b"]')


def test_folded_and_aligned():
    assert html_wrappers.folded(["<a", "=x", "<a", "=y", "<b", "=z"]) == ["+<a", "+=x", "<b", "=z"]
    assert html_wrappers.aligned(["<a", "=x", "<b"], ["<a", "=y", "<c", "<b"]) == ["<a", "#", "?<c", "<b"]


def brute(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, held = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = held @ v
            out[i] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    want, got = brute(rows), {}
    for r in QUERIES["op7_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 2)
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(50)] + [(60, None), (61, [0.0, 0.0]), (62, [1.0, None]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (65, []), (80, [0.0, 2.0]), (3, same)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = frame.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    got = {}
    for r in vector_search.nearest(frame, asked, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == list(range(1, 21)) and got[40] == list(range(20))
    assert set(got) == {0, 20, 40, 80} and len(got[80]) == 20
    assert vector_search.nearest(frame.limit(0), asked.limit(0)).count() == 0
