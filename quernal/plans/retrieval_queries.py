"""Queries of chunking, both search legs, fusion, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.operators import chunking, evaluate, fusion, lexical, rag, vector
from quernal.operators import relations as rel
from quernal.plans.registry import Register, sql_strip, sql_title, sql_tokens
from quernal.session import cut, table

register = Register()

_HEADED = "'intro' || chr(10) || '# Doc ' || doc_id || chr(10) || text || chr(10) || '## ' || lang || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '#### deep' || chr(10) || 'x' || chr(10) || '# Doc two' || chr(10) || '### ' || source || chr(10) || 'end'"


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    parts = (F.lit("intro\n# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n## "), F.col("lang"), F.lit("\n```\n# code\n```\n#### deep\nx\n# Doc two\n### "), F.col("source"), F.lit("\nend"))
    return table(spark, folder, "documents").select("doc_id", F.concat(*parts).alias("text"))


@register.query(f"""
WITH h AS (SELECT doc_id, {_HEADED} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM h),
f AS (SELECT *, starts_with(ltrim(line), '```') AS fence, coalesce(sum(CAST(starts_with(ltrim(line), '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
v AS (SELECT *, CASE WHEN inside OR fence THEN 0 ELSE length(regexp_extract(trim(line), '^(#{{1,4}})(?: +(.*))?$', 1)) END AS level FROM f),
s AS (SELECT *, sum(CAST(level > 0 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS sid, {", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS a{k}" for k in range(1, 5))} FROM v),
n AS (SELECT doc_id, pos, trim(regexp_extract(trim(line), '^(#{{1,4}})(?: +(.*))?$', 2)) AS name FROM v WHERE level > 0),
g AS (SELECT doc_id, sid, string_agg(line, chr(10) ORDER BY pos) AS text, min(a1) AS a1, min(a2) AS a2, min(a3) AS a3, min(a4) AS a4 FROM s GROUP BY doc_id, sid)
SELECT g.doc_id, CAST(sid AS BIGINT) AS sid, n1.name AS document_title, n2.name AS entity_name, n3.name AS section, n4.name AS item_name, text FROM g LEFT JOIN n n1 ON n1.doc_id = g.doc_id AND n1.pos = a1
  LEFT JOIN n n2 ON n2.doc_id = g.doc_id AND n2.pos = a2 AND a2 > coalesce(a1, -1) LEFT JOIN n n3 ON n3.doc_id = g.doc_id AND n3.pos = a3 AND a3 > greatest(coalesce(a1, -1), coalesce(a2, -1))
  LEFT JOIN n n4 ON n4.doc_id = g.doc_id AND n4.pos = a4 AND a4 > greatest(coalesce(a1, -1), coalesce(a2, -1), coalesce(a3, -1))""")
def section_headers(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sections(_headed(spark, folder))


_FIXED = """c AS (SELECT doc_id, lang, source, text AS whole, unnest(range(1, greatest(1, length(text) - 250) + 1, 1250)) AS start FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, lang, source, CAST((start - 1) // 1250 AS INTEGER) AS chunk_no, substr(whole, start, 1500) AS text FROM c)"""


@register.query(f"WITH {_FIXED} SELECT doc_id, chunk_no, text FROM k")
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.fixed(table(spark, folder, "documents")).select("doc_id", "chunk_no", "text")


@register.query()
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.recursive(table(spark, folder, "documents")).select("doc_id", "chunk_no", "text")


_KIND = "CASE WHEN lower(file) = 'enriched_api-users.md' THEN 'researcher_profile' WHEN lower(file) = 'enriched_projects_full.md' THEN 'research_project' WHEN folder = 'news' THEN 'news_article' WHEN starts_with(lower(file), 'enriched_') THEN 'research_group' ELSE 'general_research_data' END"
_FILE = "CASE doc_id % 4 WHEN 0 THEN 'Enriched_api-users.md' WHEN 1 THEN 'enriched_projects_full.md' WHEN 2 THEN 'enriched_' || source || '.md' ELSE source || '.md' END"


def _filed(df: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 4
    file = F.when(k == 0, "Enriched_api-users.md").when(k == 1, "enriched_projects_full.md").when(k == 2, F.concat(F.lit("enriched_"), "source", F.lit(".md"))).otherwise(F.concat("source", F.lit(".md")))
    return df.withColumns({"file": file, "folder": F.when(F.col("lang") == "fr", "news").otherwise("raw")}).withColumn("kind", chunking.doc_type(F.col("file"), F.array("folder")))


@register.query(f"WITH f AS (SELECT doc_id, {_FILE} AS file, CASE WHEN lang = 'fr' THEN 'news' ELSE 'raw' END AS folder FROM documents) SELECT doc_id, file, {_KIND} AS kind FROM f")
def doc_type_case(spark: SparkSession, folder: str) -> DataFrame:
    return _filed(table(spark, folder, "documents")).select("doc_id", "file", "kind")


@register.query(f"""
WITH {_FIXED}, f AS (SELECT *, {_FILE} AS file, CASE WHEN lang = 'fr' THEN 'news' ELSE 'raw' END AS folder FROM k), t AS (SELECT *, {_KIND} AS kind FROM f)
SELECT doc_id, chunk_no, '[Context: ' || {sql_title("replace(kind, '_', ' ')")} || CASE WHEN lang <> 'en' THEN ' | About: ' || lang ELSE '' END || ' | Section: ' || source || ']' || chr(10) || text AS text FROM t
WHERE NOT contains(lower(text), 'no projects found') AND NOT contains(lower(text), 'no public records found') AND length({sql_strip("replace(text, '-', '')")}) >= 50""")
def chunk_filter_prefix(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _filed(chunking.fixed(table(spark, folder, "documents"))).filter(chunking.useful(F.col("text")))
    about = F.when(F.col("lang") != "en", F.col("lang"))
    return chunks.select("doc_id", "chunk_no", chunking.with_prefix(F.col("text"), F.col("kind"), about, F.col("source"), F.lit(None).cast("string")).alias("text"))


@register.query(f"""WITH {_FIXED}, i AS (SELECT doc_id, chunk_no, text, md5(text || chr(1) || lang) AS chunk_id FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, chunk_no) AS n FROM i) SELECT chunk_id, doc_id, chunk_no, text FROM r WHERE n = 1""")
def chunk_dedup_md5(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunking.fixed(table(spark, folder, "documents")).select("doc_id", "chunk_no", "text", chunking.chunk_id(F.col("text"), F.col("lang")).alias("chunk_id"))
    return chunking.distinct(chunks, ["doc_id", "chunk_no"]).select("chunk_id", "doc_id", "chunk_no", "text")


_TOKENS = f"d AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)"


@register.query(f"""WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM d), p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d)
SELECT term, CAST(count(*) AS BIGINT) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY term""")
def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical.build(table(spark, folder, "documents"))
    return lexical.term_stats(index).select("term", "df", F.round("idf", 6).alias("idf"))


_BM25 = f"""{_TOKENS},
w AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), s AS (SELECT count(*) AS n, coalesce(sum(len(t)), 0) / count(*) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark),
p AS (SELECT term, doc_id, any_value(dl) AS dl, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
lex AS (SELECT item_id AS query_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM m QUALIFY rank <= 10)"""


def _lexical(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rag.lexical_leg(table(spark, folder, "documents"), asked)


@register.query(f"WITH {_BM25} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM lex")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _lexical(spark, folder).withColumn("score", F.round("score", 4))


_VECTOR = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT item_id AS query_id, v AS qv FROM benchmark JOIN e ON vec_id = item_id),
c AS (SELECT query_id, vec_id AS doc_id, list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)), 0) AS score FROM e, x),
vec AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM c WHERE score IS NOT NULL QUALIFY rank <= 10)"""


def _vector(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id")).join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id")
    return vector.nearest(vectors, asked)


@register.query(f"WITH {_VECTOR} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM vec")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _vector(spark, folder).withColumn("score", F.round("score", 4))


@register.query()
def vector_topk_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate neighbours, by hashing to the cells of nearest centres, of every vector whose id is divisible by 20, among all."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return vector.top(vector.approximate(vectors, asked))


_FUSED = f"""{_BM25}, {_VECTOR},
u AS (SELECT query_id, doc_id, rank, 0 AS leg, 0.6::DOUBLE AS w FROM lex UNION ALL SELECT query_id, doc_id, rank, 1, 0.4::DOUBLE FROM vec),
z AS (SELECT query_id, doc_id, sum(w / rank) AS score, min(leg * 1000 + rank) AS first FROM u GROUP BY query_id, doc_id),
fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, first, doc_id) AS rank FROM z QUALIFY rank <= 15)"""


@register.query(f"WITH {_FUSED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.fuse([_lexical(spark, folder), _vector(spark, folder)]).withColumn("score", F.round("score", 6))


_CHUNKS = f"""{_FIXED}, f AS (SELECT *, {_FILE} AS file, CASE WHEN lang = 'fr' THEN 'news' ELSE 'raw' END AS folder FROM k), y AS (SELECT *, {_KIND} AS kind FROM f),
chunks AS (SELECT doc_id * 10000 + chunk_no AS chunk, doc_id, source, kind, '[Context: ' || {sql_title("replace(kind, '_', ' ')")} || CASE WHEN lang <> 'en' THEN ' | About: ' || lang ELSE '' END || ' | Section: ' || source || ']' || chr(10) || text AS text FROM y
WHERE NOT contains(lower(text), 'no projects found') AND NOT contains(lower(text), 'no public records found') AND length({sql_strip("replace(text, '-', '')")}) >= 50)"""

_CHUNK_LEX = f"""d AS (SELECT chunk, {sql_tokens('text')} AS t FROM chunks),
w AS (SELECT chunk, len(t) AS dl, unnest(t) AS term FROM d), s AS (SELECT count(*) AS n, coalesce(sum(len(t)), 0) / count(*) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark),
p AS (SELECT term, chunk, any_value(dl) AS dl, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY term, chunk), n AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT item_id, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN n USING (term) JOIN q USING (term), s GROUP BY item_id, chunk),
lex AS (SELECT item_id AS query_id, chunk, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, chunk) AS rank FROM m QUALIFY rank <= 10)"""

_CHUNK_FUSED = f"""{_CHUNKS}, {_CHUNK_LEX}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT item_id AS query_id, v AS qv FROM benchmark JOIN e ON vec_id = item_id),
cs AS (SELECT query_id, chunk, list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)), 0) AS score FROM chunks JOIN e ON vec_id = doc_id, x),
vec AS (SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk) AS rank FROM cs WHERE score IS NOT NULL QUALIFY rank <= 10),
u AS (SELECT query_id, chunk, rank, 0 AS leg, 0.6::DOUBLE AS w FROM lex UNION ALL SELECT query_id, chunk, rank, 1, 0.4::DOUBLE FROM vec),
z AS (SELECT query_id, md5(text) AS text_key, sum(w / rank) AS score, min(leg * 1000 + rank) AS first, arg_min(chunk, (leg * 1000 + rank) * 1000000000000 + chunk) AS chunk FROM u JOIN chunks USING (chunk) GROUP BY query_id, md5(text)),
fused AS (SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, first, text_key) AS rank FROM z QUALIFY rank <= 15)"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' chunks as they are indexed: filtered, with their context before the text."""
    cut_ = _filed(chunking.fixed(table(spark, folder, "documents"))).filter(chunking.useful(F.col("text")))
    about = F.when(F.col("lang") != "en", F.col("lang"))
    text = chunking.with_prefix(F.col("text"), F.col("kind"), about, F.col("source"), F.lit(None).cast("string"))
    return cut_.select((F.col("doc_id") * 10000 + F.col("chunk_no")).alias("chunk"), "doc_id", "source", "kind", text.alias("text"))


def _chunk_search(spark: SparkSession, folder: str) -> DataFrame:
    """Both legs over chunks; a chunk has the vector of its document."""
    chunks = cut(_chunks(spark, folder))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    wanted = asked.select("query_id").join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id")
    legs = [rag.lexical_leg(chunks, asked, key="chunk"), vector.nearest(chunks.select("chunk", "doc_id").join(vectors, "doc_id"), wanted, key="chunk")]
    return rag.fused(chunks, legs, key="chunk")


@register.query(f"WITH {_CHUNK_FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk, round(score, 6) AS score, kind, source, text FROM fused JOIN chunks USING (chunk)")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_search(spark, folder).select("query_id", "rank", "chunk", F.round("score", 6).alias("score"), "kind", "source", "text")


@register.query(f"""WITH {_FUSED}, l AS (SELECT query_id, doc_id, sum(w / (60 + rank)) AS s, min(leg * 1000 + rank) AS f FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, f, doc_id) AS INTEGER) AS rank, round(s, 6) AS score FROM l QUALIFY rank <= 15""")
def legacy_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """The older ensemble: the same legs and weights with the constant of reciprocal rank fusion."""
    return fusion.fuse([_lexical(spark, folder), _vector(spark, folder)], constant=60.0).withColumn("score", F.round("score", 6))


@register.query(f"""WITH {_CHUNK_FUSED}, t AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM fused JOIN chunks USING (chunk) GROUP BY query_id)
SELECT item_id AS query_id, coalesce(context, '') AS context, 'Use the context to answer.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark LEFT JOIN t ON query_id = item_id""")
def context_assembly(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rag.prompts(_chunk_search(spark, folder), asked, "Use the context to answer.")


@register.query("""
WITH q AS (SELECT lang, CASE lang WHEN 'en' THEN 70 WHEN 'fr' THEN 60 WHEN 'de' THEN 30 ELSE 20 END AS quota FROM (SELECT DISTINCT lang FROM documents)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM documents) SELECT doc_id, lang, CAST(pick AS INTEGER) AS pick FROM r JOIN q USING (lang) WHERE pick <= quota""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    quotas = docs.select("lang").distinct().withColumn("quota", F.when(F.col("lang") == "en", 70).when(F.col("lang") == "fr", 60).when(F.col("lang") == "de", 30).otherwise(20))
    return evaluate.stratified(docs, "lang", "doc_id", quotas).select("doc_id", "lang", "pick")


@register.query("""
WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS batch, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT source, lang FROM documents)),
p AS (SELECT *, greatest(1, 60 // n) AS per FROM r), l AS (SELECT *, greatest(0, 60 - per * batch) AS rest FROM p)
SELECT source, lang, CAST(batch AS INTEGER) AS batch, CAST(CASE WHEN batch = n - 1 THEN rest ELSE least(per, rest) END AS BIGINT) AS asked FROM l""")
def batch_alloc(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "documents").select("source", "lang").distinct()
    ordered = rel.numbered(kinds, ["source"], 1, ["lang"]).select("source", "lang", F.col("pos").alias("batch"))
    n = ordered.groupBy("lang").agg(F.count("*").alias("n_batches"))
    return evaluate.batch_quotas(ordered.join(n, "lang"), 60).select("source", "lang", "batch", "asked")


@register.query(f"""WITH {_BM25}, g AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, doc_id FROM g) GROUP BY query_id),
h AS (SELECT lex.query_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM lex JOIN (SELECT DISTINCT query_id, doc_id FROM g) USING (query_id, doc_id) GROUP BY lex.query_id)
SELECT query_id, round(coalesce(h / 10.0, 0), 6) AS precision, round(coalesce(h / n::DOUBLE, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    relevant = rag.containing(docs, items)
    found = evaluate.ranking(_lexical(spark, folder), relevant, 10)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")])


@register.query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS toxic, round(avg(quality), 6) AS share_good FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def quality_by_source(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 6).alias("share_good"))


@register.query("""SELECT CASE WHEN contains(lower(file), 'user') OR contains(lower(file), 'pessoa') THEN 'people' WHEN contains(lower(file), 'project') THEN 'projects' WHEN starts_with(lower(file), 'enriched_') THEN 'groups' ELSE 'institutional' END AS topic, CAST(count(*) AS BIGINT) AS n
FROM (SELECT """ + _FILE + " AS file FROM documents) GROUP BY 1")
def file_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _filed(table(spark, folder, "documents")).groupBy(evaluate.category(F.col("file")).alias("topic")).agg(F.count("*").alias("n"))


@register.query("""SELECT doc_id, text, CASE WHEN doc_id % 3 = 1 THEN 'old' ELSE 'new' END AS version FROM documents""")
def incremental_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two thirds of the documents are stored; a batch brings half of those again and the last third for the first time."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    again, first = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), F.coalesce(F.col("doc_id") % 3 == 2, F.lit(True))
    old = docs.filter(~first).withColumn("version", F.lit("old"))
    return rag.upsert(old, docs.filter(again | first).withColumn("version", F.lit("new")), "doc_id")
