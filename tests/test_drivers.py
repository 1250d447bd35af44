"""Sources over HTTP, drivers, enrichment, the knowledge base, vector search and registered functions."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernal import drivers
from quernal.functions.register import register
from quernal.operators import chunking, crawl, enrich, knowledge, lexical, rag, vector
from quernal.sources import readers

ASKED = []


class Site(BaseHTTPRequestHandler):
    """Five pages of two items a page at /items, of which /broken lacks the fourth and /garbled isn't JSON from the third on; HTML below /site."""

    def do_POST(self):  # noqa: N802
        url = urlsplit(self.path)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        page = int(query.get("page", 0))
        ASKED.append((url.path, page, query.get("per_page"), body, self.headers.get("Authorization")))
        if url.path == "/none" or (url.path == "/broken" and page == 4):
            self.send_error(500)
            return
        text = "{garbled" if url.path == "/garbled" and page >= 3 else json.dumps({"data": [{"id": 2 * page, "name": f"n{page}"}, {"id": 2 * page + 1}], "meta": {"last_page": 5}})
        self.answer(text)

    def do_GET(self):  # noqa: N802
        pages = {"/site": '<title>Home</title><a href="/site/a">A</a><a href="/site/b">B</a><a href="https://far.org/x">X</a>', "/site/a": '<title>A</title><a href="/site/b">B</a><a href="/site/c">C</a>', "/site/b": '<title>B</title><a href="/site">Home</a><a href="/site/gone">G</a>', "/site/c": "<title>C</title>"}
        if self.path in pages:
            self.answer(pages[self.path])
        else:
            self.send_error(404)

    def answer(self, text):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ids(df):
    return sorted(json.loads(r.item)["id"] for r in df.collect())


def test_paged_endpoint(spark, site):
    ASKED.clear()
    assert ids(readers.endpoint(spark, f"{site}/items", per_page=2, token="t")) == list(range(2, 12))
    assert sorted(a[1] for a in ASKED) == [1, 2, 3, 4, 5], "every page is asked for once"
    assert {a[2:] for a in ASKED} == {("2", b"", "Bearer t")}
    assert ids(readers.endpoint(spark, f"{site}/broken")) == list(range(2, 8)), "what came before the failure stays, later pages don't"
    assert ids(readers.endpoint(spark, f"{site}/garbled")) == list(range(2, 6))
    assert readers.endpoint(spark, f"{site}/none") is None


def test_all_endpoints_saved(spark, site, tmp_path):
    found = readers.endpoints(spark, {"items": f"{site}/items", "none": f"{site}/none"})
    assert drivers.save_all(found, str(tmp_path), "both") == {"items": True, "none": False}
    saved = {r.value for r in spark.read.text(str(tmp_path / "items/markdown"), wholetext=False).collect()}
    assert "# items" in saved and "**Name:** n1" in saved
    assert spark.read.json(str(tmp_path / "items/json")).count() == 10


def test_pages_fetched_and_crawled(spark, site):
    got = {r.url: (r.html is not None, (r.error or "")[:9]) for r in readers.fetch_pages(spark.createDataFrame([(f"{site}/site",), (f"{site}/x",)], "url string")).collect()}
    assert got == {f"{site}/site": (True, ""), f"{site}/x": (False, "HTTPError")}
    records = drivers.static_source(spark, drivers.Settings(static_seeds=[f"{site}/site"], static_domain="127.0.0.1")).collect()
    assert {r.url: r.title for r in records} == {f"{site}/site{p}": t for p, t in (("", "Home"), ("/a", "A"), ("/b", "B"), ("/c", "C"))}
    with pytest.raises(ValueError):
        drivers.static_source(spark, drivers.Settings(static_seeds=["ftp://x"]))


def test_walk_over_links_until_nothing_is_new(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1"), (2, "http://a.org/2"), (3, "http://a.org/3")], "page_id int, url string")
    found = spark.createDataFrame([("http://a.org/1", "http://a.org/2/", True), ("http://a.org/2", "http://a.org/3#x", True), ("http://a.org/3", "http://a.org/1", True), ("http://a.org/3", "http://a.org/login", True), ("http://a.org/3", "http://b.org/", False)], "url string, target string, internal boolean")
    got = {(r.url, r.depth, r.known) for r in crawl.walk(pages, found, pages.filter("page_id = 1")).collect()}
    assert got == {("http://a.org/1", 0, True), ("http://a.org/2", 1, True), ("http://a.org/3", 2, True)}
    total = crawl.crawl_report(crawl.walk(pages, found, pages.filter("page_id = 1")), found).first()
    assert (total.n_urls, total.n_known, total.most_steps, total.n_links, total.n_external, total.n_repeats) == (3, 3, 2, 5, 1, 0)


def test_news_and_publications(spark):
    texts = {"https://n.org/1": '<h3>T1</h3><p class="order-1 small font-weight-semi-bold">May</p><div id="news-container"><p>a</p><p>b</p></div>', "https://doi.org/9": "<p>none</p>"}

    def get(url, timeout):
        return {"https://n.org/1": texts["https://n.org/1"], "https://doi.org/9": texts["https://doi.org/9"]}[url]

    listing = spark.createDataFrame([("/1", 0), ("/1", 1), ("https://n.org/gone", 2)], "href string, pos int")
    articles, report = drivers.news_source(spark, listing, "https://n.org", get)
    assert [(r.url, r.title, r.date, r.content) for r in articles.collect()] == [("https://n.org/1", "T1", "May", "a\nb")]
    assert tuple(report.first()) == (2, 1, 1)
    with pytest.raises(ValueError):
        drivers.news_source(spark, listing.limit(0), "https://n.org", get)
    card = '<h5 class="type">Article</h5><p class="title">P</p><div class="links"><a href="https://doi.org/9">d</a></div>'
    cards = spark.createDataFrame([("u1", card), ("u2", "<p>no card</p>")], "url string, html string")
    got = {r.url: (r.title, r.doi, r.abstract, r.keywords) for r in drivers.publication_source(spark, cards, get).collect()}
    assert got == {"u1": ("P", "https://doi.org/9", "Publisher isn't supported", []), "u2": (None, None, None, [])}


def test_conversions(spark, tmp_path):
    news = spark.createDataFrame([("T", None, None, "c", "u")], "title string, date string, image_url string, content string, url string")
    done = drivers.convert_news(news, str(tmp_path / "n"))
    assert done["success"] and len(done["json_files"]) == len(done["markdown_files"]) == 1 and not done["errors"]
    assert not drivers.convert_publications(news, str(tmp_path / "p"), "both")["errors"][0].startswith("json") and drivers.convert_publications(news, str(tmp_path / "q"))["success"]
    (tmp_path / "file").write_text("x")
    bad = drivers.convert_news(news, str(tmp_path / "file" / "below"), "json")
    assert not bad["success"] and bad["errors"] and bad["json_files"] == []
    with pytest.raises(ValueError):
        drivers.converted(news, str(tmp_path), "xml")
    assert drivers.capabilities()["publications"] == {"json": True, "markdown": False, "folders_by": None}


def test_runs_by_configuration(spark, site, tmp_path, monkeypatch):
    assert drivers.main(["--config", str(tmp_path / "none.json")]) == 2
    config = {"sources": {"api": {"enabled": True, "endpoints": {"i": f"{site}/items"}, "token_env": "T_OKEN"}, "news": {"enabled": False}}, "output": {"folder": str(tmp_path / "out")}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    monkeypatch.delenv("T_OKEN", raising=False)
    assert drivers.main(["--config", str(tmp_path / "c.json")]) == 1
    monkeypatch.setenv("T_OKEN", "x")
    ok, rows = drivers.run(spark, config)
    assert ok and [(r.source, r.success) for r in rows.collect()] == [("api", True)] and spark.read.json(str(tmp_path / "out/api")).count() == 10
    ok, rows = drivers.run(spark, config, ["api", "unknown"])
    assert not ok and {(r.source, r.success) for r in rows.collect()} == {("api", True), ("unknown", False)}


def test_retries_and_fallbacks(spark):
    waits, calls = [], []

    def refuse_twice(p):
        calls.append(p)
        if len(calls) < 3:
            raise enrich.RateLimited
        return "done"

    assert enrich.attempt(refuse_twice, "p", sleep=waits.append) == "done" and waits == [1.0, 2.0]
    assert enrich.attempt(lambda p: 1 / 0, "p", sleep=waits.append) is None and len(waits) == 2

    def client():
        def call(prompt):
            if "limit" in prompt:
                raise enrich.RateLimited
            return prompt.split("\n", 1)[1].upper()

        return call

    docs = spark.createDataFrame([(1, "a text of some length"), (2, "short"), (3, None), (4, "always at the limit")], "id int, text string")
    got = {r.id: r.summary for r in enrich.summaries(docs, "text", client, workers=2, wait=0.01).collect()}
    assert got == {1: "A TEXT OF SOME LENGTH", 2: "Too little text for a description.", 3: "Too little text for a description.", 4: enrich.FAILED}
    people = spark.createDataFrame([(1, [("A",), ("",), (None,)]), (2, [])], "id int, items array<struct<title:string>>")
    assert {r.id: r.x for r in people.select("id", enrich.joined(enrich.titles(F.col("items"))).alias("x")).collect()} == {1: "A", 2: "None"}
    assert [r.id for r in enrich.dry_run(docs, "id", 2).collect()] == [1, 2] and enrich.dry_run(docs, "id").count() == 4


def test_recursive_splits_by_hand():
    split = chunking.split_recursive
    assert split("a b c", 10, 2) == ["a b c"] and split("  ", 10, 2) == [] and split("", 5, 1) == []
    assert split("one two three four", 9, 4) == ["one two", "two three", "four"]
    assert split("aaaa\n\nbbbb\n\ncccc", 10, 4) == ["aaaa\n\nbbbb", "bbbb\n\ncccc"]
    assert split("aaaa\n\nbb bb bb bb\n\ncc", 8, 0) == ["aaaa", "bb bb bb"[:5] + " bb", "bb", "cc"]
    assert split("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    assert split("ab\ncd ef gh ij kl", 8, 3) == ["ab", "cd ef gh", "gh ij kl"]


def plain_sections(text):
    """Sections by a state for each level, line by line."""
    out, heads, fenced, body = [], {}, False, []
    for line in text.split("\n"):
        bare = line.strip(" ")
        hashes = len(bare) - len(bare.lstrip("#"))
        rest = bare[hashes:]
        if not fenced and 1 <= hashes <= 4 and (rest == "" or rest[0] == " "):
            if body:
                out.append((dict(heads), body))
            heads = {k: v for k, v in heads.items() if k < hashes} | {hashes: rest.strip(" ")}
            body = []
        if bare.startswith("```"):
            fenced = not fenced
        body.append(line)
    return [*out, (heads, body)]


def test_knowledge_base_against_plain_python(spark):
    long = " ".join(f"word{i}" for i in range(600))
    texts = ["# T\nintro " + "x" * 60 + "\n## E\n" + "y" * 70 + "\n### S\n#### I\n" + "z" * 80 + f"\n## F\n{long}\n\n{long}", "no header " * 9, "# A\n```\n# not one\n```\n" + "q" * 55, "# Short", "", "# N\nNo projects found " + "w" * 80, "#Tag\n" + "v" * 60 + "\n##### deep\n" + "u" * 60]
    rows = [(f"raw/{'news/' if i % 3 == 1 else ''}{'enriched_' if i % 2 else ''}{i}.md", t) for i, t in enumerate([*texts, texts[0]])] + [("raw/n.md", None)]
    files = spark.createDataFrame([(p, p.split("/")[-1], p.split("/")[:-1], t, p.split("/")[-1].startswith("enriched_"), "k") for p, t in rows], "path string, file_name string, folders array<string>, content string, is_enriched boolean, sid string")
    want, seen = [], set()
    for p, t in sorted(rows):
        name = p.split("/")[-1]
        kind = "News Article" if "news" in p.split("/")[:-1] else "Research Group" if name.startswith("enriched_") else "General Research Data"
        for heads, body in plain_sections(t) if t is not None else []:
            for c in chunking.split_recursive("\n".join(body)):
                if "no projects found" in c.lower() or len(c.replace("-", "").strip()) < 50:
                    continue
                about = [f"{n}: {heads[k]}" for k, n in ((2, "About"), (3, "Section"), (4, "Item")) if k in heads]
                text = f"[{' | '.join([f'Context: {kind}', *about])}]\n{c}"
                if (text, name, tuple(sorted(heads.items()))) not in seen:
                    seen.add((text, name, tuple(sorted(heads.items()))))
                    want.append((name, heads.get(1), text))
    got = knowledge.build(files).collect()
    assert sorted(map(str, ((r.source_file, r.document_title, r.text) for r in got))) == sorted(map(str, want)) and len({r.chunk_id for r in got}) == len(got)
    assert knowledge.build(files.limit(0)).count() == 0 and knowledge.warm(knowledge.build(files)) == len(got)


def test_vector_search_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(1)
    m = r.integers(-3, 4, (400, 6)).astype(float)
    m[10] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(None, [1.0] * 6), (900, None), (901, [1.0]), (902, [])]
    vectors = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", m[i].tolist()) for i in range(0, 400, 20)] + [(None, [1.0] * 6), ("z", [0.0] * 6), ("n", None)], "query_id string, embedding array<double>")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = {}
    for i in range(0, 400, 20):
        s = np.round(unit @ unit[i], 6)
        for rank, j in enumerate([j for j in np.lexsort((np.arange(400), -s)) if j != 10][:7], 1):
            want[f"q{i}", rank] = int(j), float(unit[i] @ unit[j])
    for size in (vector.BLOCK_BYTES, 200):
        monkeypatch.setattr(vector, "BLOCK_BYTES", size)
        got = {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in vector.nearest(vectors, asked, 7).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - v[1]) < 1e-6 for k, v in want.items())
    assert vector.nearest(vectors.limit(0), asked, 7).count() == 0 and vector.nearest(vectors, asked.limit(0), 7).count() == 0


def test_approximate_search_finds_nearly_all(spark):
    """Recall against the exact neighbours at two scales, of the rows that the query uses."""
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
        asked = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
        exact = {(r.query_id, r.doc_id) for r in vector.nearest(vectors, asked).collect()}
        near = {(r.query_id, r.doc_id) for r in vector.top(vector.approximate(vectors, asked)).collect()}
        assert len(exact & near) >= 0.9 * len(exact), folder


def test_lexical_search_of_long_term_lists(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 17}" for k in range(1, 9))) for i in range(40)] + [(99, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(q, f"t{q} t{q + 3} t{q + 5} nothing") for q in range(8)], "query_id int, query string")
    whole = {(r.query_id, r.doc_id, round(r.score, 6)) for r in lexical.score(docs, asked).collect()}
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 3)
    assert {(r.query_id, r.doc_id, round(r.score, 6)) for r in lexical.score(docs, asked).collect()} == whole and whole
    ranked = {(r.query_id, r.doc_id, round(r.score, 6)) for r in lexical.nearest(docs, asked, 50).collect()}
    assert ranked == whole
    monkeypatch.setattr(lexical, "BATCH", 3)
    few = {(r.query_id, r.doc_id, r["rank"]) for r in lexical.nearest(docs, asked, 5).collect()}
    assert few == {(r.query_id, r.doc_id, r["rank"]) for r in lexical.top(lexical.score(docs, asked), 5).collect()} and len(few) == 40
    assert lexical.nearest(docs.limit(0), asked).count() == 0 and lexical.nearest(docs, asked.limit(0)).count() == 0
    stored = lexical.build(docs)
    assert {(r.query_id, r.doc_id, round(r.score, 6)) for r in lexical.search_index(stored, asked).collect()} == whole


def test_equal_texts_are_one_result(spark):
    docs = spark.createDataFrame([(1, "red harbour boats"), (2, "red harbour boats"), (3, "green hills")], "doc_id int, text string")
    found = rag.search(docs, spark.createDataFrame([(1, "harbour boats")], "query_id int, query string"))
    texts = [r.text for r in found.orderBy("rank").collect()]
    assert texts[0] == "red harbour boats" and len(texts) == len(set(texts)) and found.filter("rank = 1").first().doc_id == 1


def test_question_to_answer(spark):
    docs = spark.createDataFrame([(1, "red harbour boats"), (2, "green hills and sheep")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "Tell me of the Old Harbour boats"), (2, "  "), (3, "exit")], "query_id int, query string")
    got = rag.converse(docs, asked, "S", lambda p: hashlib.md5(p.encode()).hexdigest()).collect()
    assert [r.query_id for r in got] == [1] and got[0].keywords == "Old Harbour" and got[0].context.startswith("red harbour boats")
    assert got[0].prompt == f"S\n\nContext:\n{got[0].context}\n\nQuestion: Tell me of the Old Harbour boats" and got[0].answer == hashlib.md5(got[0].prompt.encode()).hexdigest()


def test_registered_functions(spark):
    names = register(spark)
    assert len(names) == len(set(names)) >= 9
    row = spark.sql("""SELECT short_sha('0123456789') AS a, plain_query(' "x" ') AS b, without_prefix('enriched_a', 'enriched_') AS c, html_title('<title>T</title>') AS d, size(text_chunks(repeat('ab ', 900))) AS e, json_markdown('{"a": 1}') AS f""").first()
    assert tuple(row)[:4] == ("0123456", "x", "a", "T") and row.e == 2 and "**A:** 1" in row.f
    assert [r.sid for r in spark.sql("SELECT sid FROM text_sections('a\\n# b\\n## c')").collect()] == [0, 1, 2]
