"""All catalogue queries against their SQL, chunking properties, search, sources, sinks and streams."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernal.operators import chunking, fusion, observe, rag, vector
from quernal.plans import catalogue
from quernal.sources import readers, writers
from quernal.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, pq.read_table(f"{data}/{t}.parquet"))
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, data, duck, name):
    got = catalogue.queries()[name](spark, data)
    rows = got.collect()
    if name not in catalogue.oracle_sql():
        assert got.columns
        return
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted([plain(r[c]) for c in names] for r in rows) == sorted([plain(v) for v in r] for r in want.fetchall())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(20, 60))
def test_recursive_chunks(t, size):
    chunks = chunking.split_recursive(t, size, size // 4)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(t.split())) == set("".join("".join(chunks).split()))


def test_fusion_bounds_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 13, 1)], "query_id int, doc_id int, rank int")
    got = [(r.doc_id, round(r.score, 3)) for r in fusion.fuse([a, b]).orderBy("rank").collect()]
    assert got == [(10, 1.0), (13, 0.4), (11, 0.3), (12, 0.2)]


def test_search_and_answer(spark):
    docs = spark.createDataFrame([(1, "red harbour boats"), (2, "green hills and sheep"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "'harbour' boats"), (2, "")], "query_id int, query string")
    found = rag.search(docs, asked)
    assert found.filter("query_id = 1 and rank = 1").first().doc_id == 1
    got = {r.query_id: r.answer for r in rag.answer(found, asked, "S", lambda p: p[-5:]).collect()}
    assert got[1] == "boats" and set(got) == {1, 2}
    with pytest.raises(ValueError):
        vector.provider("none")


def test_plans_of_both_legs(spark, data):
    plan = catalogue.queries()["vector_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw" / "api").mkdir(parents=True)
    (tmp_path / "new").mkdir()
    for f in ("raw/a.md", "raw/b.md", "raw/api/c.md", "new/enriched_b.md"):
        (tmp_path / f).write_text(f"# {f}\n\ntext")
    files = readers.knowledge_files(spark, str(tmp_path / "new"), str(tmp_path / "raw"))
    assert {r.file_name for r in files.collect()} == {"a.md", "enriched_b.md"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text('{"news": [{"title": "a"}, {"title": "b"}]}')
    (tmp_path / "j/y.json").write_text("{broken")
    assert {r.title for r in readers.unwrap(readers.read_json(spark, str(tmp_path / "j"))).collect()} == {"a", "b"}
    df = spark.createDataFrame([("x", "# one\ntwo"), ("y", "# z")], "k string, markdown string")
    assert set(writers.write(df, str(tmp_path / "out"))) == {"json", "markdown"}
    assert {r.value for r in spark.read.text(str(tmp_path / "out/markdown"), wholetext=False).collect()} == {"# one", "two", "# z"}
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path), "xml")
    assert writers.wrapped(df.select("k"), "items", "k").first().value == '{"items":[{"k":"x"},{"k":"y"}]}'
    frames, failed = readers.Dispatcher({"sources": {"a": {"enabled": True}}}, {"a": lambda: df, "b": lambda: 1 / 0}).run(["a", "b", "c"])
    assert set(frames) == {"a"} and set(failed) == {"b", "c"}
    assert readers.load_config(str(tmp_path / "none.yaml")) == {} and not readers.is_enabled({}, "a")


def test_upsert_and_streams(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.filter("doc_id < 100").write.parquet(str(tmp_path / "in/1"))
    docs.filter("doc_id >= 50").write.parquet(str(tmp_path / "in/2"))
    q = incremental.upsert_stream(spark, str(tmp_path / "in/*"), "doc_id bigint, text string", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    ids = [r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.chunk_id for r in incremental.chunks_of(docs).collect()}
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    s = incremental.window_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    s.writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").selectExpr("sum(n)").first()[0] == observe.windows(events).selectExpr("sum(n)").first()[0]


def test_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_packages_of_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op4') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], check=True)  # noqa: S603
    assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) >= 64


def test_python_workers_find_the_package_wherever_the_driver_runs(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    names = ["bm25_topk", "vector_topk", "html_images", "convert_counts", "chunk_recursive", "section_headers"]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print([e.queries()[n](spark, {"/root/testdata/sf0.001"!r}).count() > 0 for n in {names!r}])
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=False)  # noqa: S603
    assert done.stdout.strip() == str([True] * len(names)), done.stderr[-2000:]


def test_approximate_search_shuffles_no_vectors_and_settles_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(i, [0.0, float(i % 7), 1.0]) for i in range(300, 600)] + [(700, None), (701, [0.0, 0.0, 0.0]), (702, [1.0]), (None, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 7.0, 1.0]), (3, None), (4, [0.0, 0.0, 0.0])], "query_id int, embedding array<float>")
    near = vector.approximate(vectors, asked, recall=1.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    want = [tuple(r) for r in vector.nearest(vectors, asked).orderBy("query_id", "rank").select("query_id", "doc_id", "rank").collect()]
    got = [tuple(r) for r in vector.top(near).orderBy("query_id", "rank").select("query_id", "doc_id", "rank").collect()]
    assert got == want and len(got) == 20 and [d for q, d, _ in got if q == 1] == list(range(10))
    assert vector.approximate(vectors.limit(0), asked).count() == 0 and vector.approximate(vectors, asked.limit(0)).count() == 0


def test_candidates_of_approximate_search_are_bounded(monkeypatch):
    monkeypatch.setattr(vector, "HELD", 5)
    best, scores = vector._Best(2, 3), np.round(np.random.default_rng(0).random((2, 200)), 2)
    for at in range(0, 200, 20):
        best.add(np.arange(2), scores[:, at : at + 20], np.arange(at, at + 20))
        assert best.n_held <= 5 + 2 * 3
    query, score, key = best.settle()
    for q in range(2):
        order = np.lexsort((np.arange(200), -scores[q]))[:3]
        assert key[query == q].tolist() == order.tolist() and score[query == q].tolist() == scores[q, order].tolist()


def test_pieces_are_made_slice_by_slice(spark):
    texts = [(i, i % 7, None if i % 5 == 0 else f"a\n# H{i}\nb" * (i % 3)) for i in range(2 * chunking.SLICE + 3)]
    docs = spark.createDataFrame(texts, "doc_id int, kind int, text string").coalesce(1)
    found = chunking.sections(docs, rest=("kind",))
    assert sorted((r.doc_id, r.kind, r.sid, r.text) for r in found.collect()) == sorted((i, k, s[0], s[-1]) for i, k, t in texts if t is not None for s in chunking.split_sections(t))
    cut = chunking.recursive(docs, 8, 2)
    assert sorted((r.doc_id, r.kind, r.chunk_no, r.text) for r in cut.collect()) == sorted((i, k, n, c) for i, k, t in texts for n, c in enumerate(chunking.split_recursive(t or "", 8, 2)))
    for df in (found, cut):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "EvalPython" not in plan


def test_items_in_documents(spark):
    items = [(1, "the harbour at night"), (2, "the harbour at noon!"), (3, ""), (4, "é"), (5, None), (1, "the harbour at night"), (6, "the harbour"), (7, "%_%_%_%_%"), (8, "aaaaaaaa"), (9, "ät night and"), (10, "short")]
    docs = [(1, "so the harbour at nightfall, ät night and"), (2, None), (3, ""), (4, "the harbour at"), (5, " noon! short é"), (6, "aaaaaaaaaaa%_%_%_%_%"), (7, "the harbour at the harbour at noon!"), (8, "night"), (1, "é")]
    got = rag.containing(spark.createDataFrame(docs, "doc_id int, text string").coalesce(1), spark.createDataFrame(items, "query_id int, item string"))
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == sorted({(q, d) for q, i in items for d, t in docs if i is not None and t is not None and i in t})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rag.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "query_id int, item string")).count() == 0
