"""Golden cases of the text, URL, HTML and rendering functions."""

import pytest
from pyspark.sql import functions as F

from quernal.functions import html, render, text, urls

PAGE = """<html><head><meta content="Og" property="og:title"><title>Main {{x}} Title</title></head><body><h1>First</h1>
<nav class="navbar"><p>A paragraph of the navigation that is long enough.</p></nav><div class="body"><h2>Part one</h2>
<p>The first paragraph is long enough.<p>Too short.</p><p>The first paragraph is long enough.</p><p>Another {{a}} long paragraph, kept.</p>
<a href="/about">About</a><a href="https://other.org/x">Other</a><a href="#top">Top</a><a href="javascript:go()">Go</a><a href="/download-file/1">File</a><a href="../up">Up</a><img src="/i.png" alt="I"></div></body></html>"""


def one(spark, column, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("Hi {{name}} you", "Hi you"), ("A {% if b %}c{% endif %} d", "A c d"), ("T [[ v ]] u", "T u"), ("a<!-- c -->b", "ab"), ("a  b \n\n c", "a b c"), ("a<!-- c-d -->b", "a<!-- c-d -->b"), ("", ""), (None, ""), (" x y ", "x y")])
def test_clean(spark, given, want):
    assert one(spark, text.clean, given) == want


@pytest.mark.parametrize(("given", "want"), [("https://Ex.com/p/?utm_source=t&PHPSESSID=z#s", "https://ex.com/p"), ("https://ex.com/p?utm_a=1&keep=v", "https://ex.com/p?keep=v"), ("/page", "/page"), ("", ""), (None, ""), ("http://a.b/c///", "http://a.b/c"), ("http://a.b?x=1?y", "http://a.b?x=1?y")])
def test_normalize(spark, given, want):
    assert one(spark, urls.normalize, given) == want


def test_labels_slugs_and_aliases(spark):
    assert one(spark, text.label, "api_v2_token") == "Api V2 Token" and one(spark, text.label, "o'neil-x") == "O'Neil-X"
    assert one(spark, text.slug, " Café  Não! ") == "caf-no" and one(spark, text.filename, 'a/b:c d') == "a_b_c_d"
    assert one(spark, text.name_aliases, "Ana Maria B Silva") == ["A. M. B. Silva", "A. Silva", "Ana Silva"] and one(spark, text.name_aliases, "Ana") == []
    assert one(spark, text.sanitize_query, " 'a' \"b\" ") == "a b" and one(spark, lambda c: text.default(c, "d"), " ") == "d"


def test_html_parts(spark):
    df = spark.createDataFrame([(1, "https://ex.com/a/b", PAGE), (2, None, None), (3, "https://ex.com", "<h1>Only {%x%} head</h1><div>" + "Long words here. " * 8 + "</div>")], "page_id int, url string, html string")
    p = html.parsed(df)
    got = {r.page_id: r for r in p.select("page_id", html.title(p).alias("t"), html.paragraphs(p).alias("p"), html.headings(p).alias("h")).collect()}
    assert got[1].t == "Main Title" and got[1].p == ["The first paragraph is long enough.", "Another long paragraph, kept."] and got[1].h == ["Part one"]
    assert got[2].t == "No Title Found" and got[2].p == [] and got[3].t == "Only head" and len(got[3].p) == 1
    from quernal.operators import crawl

    links = {r.target: r.internal for r in crawl.links(p, "ex.com").collect()}
    assert links == {"https://ex.com/about": True, "https://other.org/x": False, "https://ex.com/up": True}
    assert [(r.alt, r.src) for r in crawl.images(p).collect()] == [("I", "https://ex.com/i.png")]


@pytest.mark.parametrize("name", ["html_headings", "page_title"])
def test_references_without_semicolon_stay_as_in_sql(spark, tmp_path, name):
    import duckdb

    from quernal.plans import catalogue

    heads = ["a&amp;&amp", "b &lt;i&gt; &amp;lt; &nbsp;x", "c & d", "&ampx; e &notit; &lt", "f&quot;g&#39;h&#39 &"]
    pages = [(i, f"https://ex.com/{i}", f"<html><head><title>{h}</title></head><body><h1>{h}</h1></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall())


def test_page_title_is_as_in_sql_on_odd_pages(spark, tmp_path):
    import duckdb

    from quernal.plans import catalogue

    given = [
        None, "", "<title></title><h1>H</h1>", "<title> \n </title><h1>H</h1>", "<title>&nbsp;</title><h1>H</h1>", "<h1>Only a head</h1>", '<meta property="og:title" content="Og">', '<title lang="en">A</title><h1>H</h1>', "<TITLE>A</TITLE>",
        "<title>Cut off", "<title>A <!-- c --> b</title>", "<title>A<3</title>", "<!-- <title>Old</title> --><title>New</title>", "<title></title><title>Second</title>", "<title>A <b>b</b></title><title>C</title>", "<title>a\r\n\x1c\x85 b\u3000</title>",
        "<title>{{x}}</title><h1>H</h1>", "<title>&lt;!-- x --&gt; y</title>", "<title>[[a]] b</title>", "<title>&#39;a&#39; &#x27;b&#x27; &apos;</title>", "<title>&copy; &LT; &#38; &#0;</title>", "<title>&amp;amp; &amp;lt; &amp;#39;</title>", "<title>a&&&amp;&am</title>", "<title>a &gt; > &quot;\"</title>",
    ]
    pages = [(i, f"https://ex.com/{i}", h) for i, h in enumerate(given)]
    spark.createDataFrame(pages, "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT page_id, title FROM ({catalogue.oracle_sql()['page_title']})").fetchall())
    got = {r.page_id: r.title for r in catalogue.queries()["page_title"](spark, str(tmp_path)).collect()}
    assert len(want) == len(given) and got == want


def test_render(spark):
    assert [render.scalar(v) for v in (None, True, False, 42, "<p>a <b>b</b></p>")] == ["*None*", "✓ Yes", "✗ No", "42", "a b"]
    assert render.render([]) == "Empty" and render.document("{bad") is None
    assert render.document('[{"title": "T", "tags": ["a"]}]', "D").startswith("# D\n\n### T\n")


def test_bibtex(spark):
    m = one(spark, text.bibtex_fields, '@Book{k, title = "A  B", year = 2001, year = {2002}, note = {}}')
    assert m == {"type": "book", "citation_key": "k", "title": "A B", "year": "2002"}
    assert one(spark, lambda c: text.bibtex_markdown(text.bibtex_fields(c)), "none") == "*Invalid or empty BibTeX*"


def test_a_parsed_page_leaves_no_cycles_and_no_whole_batch(spark, data):
    import gc

    from quernal.plans import catalogue

    html.extract(PAGE)
    gc.collect()
    gc.disable()
    try:
        assert html.extract(PAGE)["title_tag"] == "Main {{x}} Title" and gc.collect() == 0
    finally:
        gc.enable()
    for name in ("first_links_per_page", "crawl_totals"):
        plan = catalogue.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
    ids = [(i, None, PAGE if i % 3 else None) for i in range(2 * html.SLICE + 3)]
    p = html.parsed(spark.createDataFrame(ids, "page_id int, url string, html string").coalesce(1))
    assert {r.page_id: r.h1 for r in p.collect()} == {i: "First" if h else None for i, _, h in ids}


def test_slug_of_odd_texts_by_short_expressions(spark):
    import re

    given = ["", "-", " - a  -- b - ", "A\u00a0\u2003B\u3000", "x !!! y", "Ünï çode\n\t\x1c1", "--é--", "\u1680z\u2028-\u2029z\x85", "a_b.c/d", "K \u212a İ"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate([*given, None])], "i int, c string").coalesce(1)
    out = df.select("i", F.lower("c").alias("low"), text.slug(F.col("c")).alias("slug"))
    for r in out.collect():
        want = None if r.low is None else re.sub("^-+|-+$", "", re.sub(f"[{re.escape(text.WHITE)}]+", "-", re.sub(f"[^a-z0-9{re.escape(text.WHITE)}-]", "", r.low)))
        assert r.slug == want, r
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "x{2000}" not in plan and "-+$" not in plan
