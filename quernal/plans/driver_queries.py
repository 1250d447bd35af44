"""Queries of what runs around the search: lists, files, reports, renderings and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.functions import render, text
from quernal.operators import chunking, enrich, evaluate, knowledge, observe
from quernal.operators import relations as rel
from quernal.plans.registry import Register, sql_slug, sql_strip, sql_tokens
from quernal.session import table
from quernal.sources import readers, writers

register = Register()

_TITLED = "SELECT source, string_agg(lang || ' ' || doc_id, '; ' ORDER BY doc_id) FILTER (WHERE doc_id % 4 <> 0) AS all_titles, list(lang || ' ' || doc_id ORDER BY doc_id) FILTER (WHERE doc_id % 4 <> 0) AS t FROM documents GROUP BY source"


def _titled(spark: SparkSession, folder: str) -> DataFrame:
    """source and its documents as items; every fourth item has an empty title."""
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat_ws(" ", "lang", F.col("doc_id").cast("string")))
    items = F.array_sort(F.collect_list(F.struct("doc_id", title.alias("title")))).alias("items")
    return table(spark, folder, "documents").groupBy("source").agg(items)


@register.query(f"SELECT source, coalesce(all_titles, 'None') AS titles FROM ({_TITLED})")
def title_list(spark: SparkSession, folder: str) -> DataFrame:
    return _titled(spark, folder).select("source", enrich.joined(enrich.titles(F.col("items")), mark="; ").alias("titles"))


@register.query(f"SELECT source, CASE WHEN t IS NULL THEN 'No publications to tell the focus from.' ELSE array_to_string(t[1:20], '; ') END AS focus FROM ({_TITLED})")
def publication_focus(spark: SparkSession, folder: str) -> DataFrame:
    """From at most twenty titles, which is the feature."""
    return enrich.focus(_titled(spark, folder), enrich.titles(F.col("items"))).select("source", "focus")


@register.query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pos, text AS content, role AS metadata FROM conversations")
def content_with_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Contents and roles as two arrays of a conversation, put together by position."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    both = table(spark, folder, "conversations").groupBy("conv_id").agg(ordered.alias("o"))
    pairs = readers.zipped(F.transform("o", lambda x: x["text"]), F.transform("o", lambda x: x["role"]))
    return both.select("conv_id", F.posexplode(pairs).alias("pos", "p")).select("conv_id", "pos", "p.content", "p.metadata")


@register.query("SELECT b.item_id AS query_id, CAST(length(text) AS BIGINT) AS n, CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' END AS difficulty FROM benchmark b")
def metrics_by_question(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    questions = items.filter("query_id % 3 <> 2").select("query_id", F.when(F.col("query_id") % 3 == 0, "easy").otherwise("hard").alias("difficulty"))
    return enrich.with_question(items.select("query_id", F.length("text").cast("bigint").alias("n")), questions.union(questions), "difficulty")


@register.query("WITH f AS (SELECT url AS path, array_to_string(string_split(url, '/')[1:len(string_split(url, '/')) - 1], '/') AS folder FROM pages) SELECT path, CAST(row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS INTEGER) AS pos FROM f")
def files_in_order(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.split("url", "/")
    files = table(spark, folder, "pages").select(F.col("url").alias("path"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"))
    return readers.in_order(files).select("path", "pos")


@register.query("""WITH d AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS content, CASE WHEN doc_id % 2 = 0 THEN 'i.png' WHEN doc_id % 3 = 0 THEN 'No image found' END AS image_url FROM documents)
SELECT CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE trim(coalesce(content, '')) <> '') AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE trim(coalesce(content, '')) = '') AS BIGINT) AS skipped,
  CAST(coalesce(sum(length(content)) FILTER (WHERE trim(coalesce(content, '')) <> ''), 0) AS BIGINT) AS characters, CAST(count(*) FILTER (WHERE image_url = 'i.png') AS BIGINT) AS images, CAST(count(*) FILTER (WHERE coalesce(image_url, '') <> 'i.png') AS BIGINT) AS images_missing FROM d""")
def conversion_totals(spark: SparkSession, folder: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text"))
    image = F.when(F.col("doc_id") % 2 == 0, "i.png").when(F.col("doc_id") % 3 == 0, "No image found")
    return observe.conversion_report(table(spark, folder, "documents").select(content.alias("content"), image.alias("image_url")))


@register.query("WITH s AS (SELECT source, bool_and(length(text) > 10) AS success FROM documents GROUP BY source) SELECT CAST(count(*) AS BIGINT) AS n_sources, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS n_ok, coalesce(bool_and(success), true) AS all_ok FROM s")
def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "documents").groupBy("source").agg(F.bool_and(F.length("text") > 10).alias("success"))
    return observe.source_report(results)


@register.query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'converted' END AS status, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def convert_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON, every fifth cut short, converted to Markdown and counted by outcome."""
    whole = F.to_json(F.struct(F.lit("d").alias("name"), F.col("text")))
    given = F.when(F.col("doc_id") % 5 == 0, F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    made = table(spark, folder, "documents").select(render.json_to_markdown(given, F.lit("T")).alias("markdown"))
    return made.groupBy(F.when(F.col("markdown").isNull(), "failed").otherwise("converted").alias("status")).agg(F.count("*").alias("n"))


_NOISE = ("run together", "the")


@register.query(f"""WITH l AS (SELECT doc_id, {sql_strip('line')} AS line, pos FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
c AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS body FROM l WHERE line <> '' AND NOT contains(line, 'run together') AND NOT contains(line, 'the') GROUP BY doc_id)
SELECT doc_id, '# ' || source || chr(10) || chr(10) || '**Source:** [' || doc_id || '](' || doc_id || ')' || chr(10) || '**Category:** ' || coalesce(lang, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || CASE WHEN body IS NULL THEN '' ELSE '## Content' || chr(10) || chr(10) || body || chr(10) END AS markdown FROM documents LEFT JOIN c USING (doc_id)""")
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    made = render.page_markdown(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.array(F.coalesce("text", F.lit(""))), _NOISE)
    return docs.select("doc_id", made.alias("markdown"))


@register.query("SELECT doc_id, lang, 'a' AS part FROM documents WHERE text IS NOT NULL UNION ALL SELECT vec_id, NULL, 'b' FROM embeddings")
def unwrapped_union(spark: SparkSession, folder: str) -> DataFrame:
    """A wrapper's items, one a row, and all rows of another source beside them."""
    wrapped = table(spark, folder, "documents").filter("text is not null").groupBy("source").agg(F.collect_list(F.struct("doc_id", "lang")).alias("data")).select("data")
    other = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("b").alias("part"))
    return readers.union([readers.unwrap(wrapped).withColumn("part", F.lit("a")), other]).select("doc_id", "lang", "part")


@register.query("SELECT d.doc_id, 'f' || d.doc_id || '.md' AS source_file, l.doc_id IS NOT NULL AS is_enriched, CASE WHEN l.doc_id IS NOT NULL THEN 'research_group' ELSE 'general_research_data' END AS type FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched files, the raw ones without such, and what a chunk says of either."""
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"))
    new = docs.join(table(spark, folder, "labels").select("doc_id").distinct(), "doc_id").withColumn("file_name", F.concat(F.lit("enriched_"), "file_name"))
    every = readers.union([new.withColumn("is_enriched", F.lit(True)), rel.not_enriched(docs, new).withColumn("is_enriched", F.lit(False))])
    kind = chunking.doc_type(F.col("file_name"), F.array(F.lit("raw")))
    return every.select("doc_id", text.strip_prefix(F.col("file_name")).alias("source_file"), "is_enriched", kind.alias("type"))


@register.query("""WITH e AS (SELECT n_nationkey AS k, '---' || chr(10) || 'title: ' || n_name || chr(10) || 'date: Unknown Date' || chr(10) || 'source: s' || chr(10) || 'url: ' || chr(10) || '---' || chr(10) || chr(10) || '![Image not found](No image)' || chr(10) || chr(10) || '*Published: Unknown Date*' || chr(10) || chr(10) || CAST(n_regionkey AS VARCHAR) || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS entry FROM nation)
SELECT '# News' || chr(10) || chr(10) || 'Total: ' || count(*) || chr(10) || chr(10) || string_agg(entry, '' ORDER BY k) AS value FROM e""")
def combined_news(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    entry = render.news_entry(F.col("n_name"), none, none, F.col("n_regionkey").cast("string"), none, F.lit("s"))
    return writers.combined(table(spark, folder, "nation").withColumn("entry", entry), "entry", ["n_nationkey"])


@register.query("""SELECT '{"nations":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS value FROM nation""")
def wrapped_json(spark: SparkSession, folder: str) -> DataFrame:
    return writers.wrapped(table(spark, folder, "nation").select("n_nationkey", "n_name"), "nations", "n_nationkey")


@register.query(f"""SELECT p_partkey, {sql_slug('p_brand')} || CASE WHEN p_partkey % 2 = 0 THEN '/' || {sql_slug('p_type')} ELSE '' END || '/' || replace(regexp_replace(p_name, '[<>|"?*:/\\\\]', '_', 'g'), ' ', '_') || '.md' AS path FROM part""")
def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    sub = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", writers.file_path(F.col("p_brand"), sub, F.col("p_name")).alias("path"))


_T = lambda x: f"list_distinct({sql_tokens(x)})"
_SHARE = lambda a, b: f"round(coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}), 0), 0), 6)"


@register.query(f"""WITH r AS (SELECT item_id, text AS q, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 3) AS g, [text, lpad(CAST(item_id AS VARCHAR), 5, '0')] AS c FROM benchmark),
t AS (SELECT item_id, {_T('q')} AS q, {_T('a')} AS a, {_T('g')} AS g, {_T("array_to_string(c, ' ')")} AS k, {_T('c[1]')} AS c1, {_T('c[2]')} AS c2 FROM r)
SELECT item_id, (CASE WHEN {_SHARE('g', 'c1')} >= 0.5 THEN 1 ELSE 0 END + CASE WHEN {_SHARE('g', 'c2')} >= 0.5 THEN 1 ELSE 0 END) / 2.0::DOUBLE AS context_precision, {_SHARE('g', 'k')} AS context_recall, {_SHARE('a', 'k')} AS faithfulness, {_SHARE('q', 'a')} AS answer_relevancy FROM t""")
def answer_overlap(spark: SparkSession, folder: str) -> DataFrame:
    half = (F.length("text") / 2).cast("int")
    records = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"), F.substr("text", F.lit(1), half).alias("answer"), F.substr("text", F.greatest((F.length("text") / 3).cast("int"), F.lit(1))).alias("ground_truth"), F.array("text", F.lpad(F.col("item_id").cast("string"), 5, "0")).alias("contexts"))
    names = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")
    return evaluate.answer_overlap(records).select("item_id", *[F.round(c, 6).alias(c) for c in names])


@register.query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 25")
def dry_run(spark: SparkSession, folder: str) -> DataFrame:
    """The limit is the feature: a trial run over the first rows."""
    return enrich.dry_run(table(spark, folder, "benchmark"), "item_id", 25).select("item_id", "text")


@register.query("WITH u AS (SELECT md5(text) AS m FROM documents WHERE text IS NOT NULL) SELECT CAST(count(*) AS BIGINT) AS n_before, CAST(count(DISTINCT m) AS BIGINT) AS n_after, CAST(count(*) - count(DISTINCT m) AS BIGINT) AS n_dropped FROM u")
def dedup_counts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("chunk_id"))
    return knowledge.counts(chunks, chunking.distinct(chunks, ["doc_id"]))


@register.query()
def knowledge_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The knowledge base of the documents, each a file with headers: recursive splits are beyond SQL, the tests compare with plain Python."""
    docs = table(spark, folder, "documents")
    n = F.col("doc_id").cast("string")
    content = F.concat(F.lit("# Doc "), n, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n## "), "lang", F.lit("\n\n### "), "source", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    enriched = F.col("doc_id") % 2 == 0
    name = F.concat(F.when(enriched, "enriched_").otherwise(""), n, F.lit(".md"))
    files = docs.select(n.alias("path"), name.alias("file_name"), F.array(F.when(F.col("lang") == "fr", "news").otherwise("raw")).alias("folders"), content.alias("content"), enriched.alias("is_enriched"))
    return knowledge.build(files)
