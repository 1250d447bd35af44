"""Queries of the text and rendering functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.functions import render, text
from quernal.plans.registry import Register, sql_clean, sql_slug, sql_strip, sql_title, sql_tokens
from quernal.session import table

register = Register()
ACRONYMS = {"THE": "The Harbour Exchange", "LE": "Local Exchange", "DE": "Data Engineering"}

_MARKED = "'Start {% if shown %}  {{name}} ' || text || ' [[ ref ]]<!-- note -->' || chr(160) || '<!-- a-b --> end'"


@register.query(f"SELECT doc_id, {sql_clean(_MARKED)} AS cleaned FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.concat(F.lit("Start {% if shown %}  {{name}} "), "text", F.lit(" [[ ref ]]<!-- note --> <!-- a-b --> end"))
    return table(spark, folder, "documents").select("doc_id", text.clean(marked).alias("cleaned"))


def _first_seen(each: str, size: str) -> str:
    """Cleaned lines of each document, first occurrences in order."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, {each} AS line, pos FROM l),
f AS (SELECT doc_id, line, min(pos) AS pos FROM c WHERE {size} GROUP BY doc_id, line),
a AS (SELECT doc_id, array_agg(line ORDER BY pos) AS lines FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(lines, chr(10)), '') AS kept, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_kept FROM documents LEFT JOIN a USING (doc_id)"""


@register.query(_first_seen(sql_clean("line"), "length(line) >= 20"))
def clean_paragraph_array(spark: SparkSession, folder: str) -> DataFrame:
    kept = text.clean_paragraphs(F.split("text", "\n", -1))
    return table(spark, folder, "documents").select("doc_id", kept.alias("a")).select("doc_id", F.array_join("a", "\n").alias("kept"), F.size("a").alias("n_kept"))


@register.query(_first_seen(sql_clean("'{{mark}}' || line"), "line <> ''"))
def clean_heading_array(spark: SparkSession, folder: str) -> DataFrame:
    kept = text.clean_headings(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("{{mark}}"), x)))
    return table(spark, folder, "documents").select("doc_id", kept.alias("a")).select("doc_id", F.array_join("a", "\n").alias("kept"), F.size("a").alias("n_kept"))


@register.query(r"SELECT doc_id, coalesce(len(regexp_extract_all('{{' || text || '[[', '\{\{|\{%|\[\[')) / length('{{' || text || '[[') > 0.5, false) AS template FROM documents")
def template_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.is_template(F.concat(F.lit("{{"), "text", F.lit("[["))).alias("template"))


@register.query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || '{{{{x}}}}  '), chr(10)), lambda x: {sql_clean('x')}), lambda x: x <> ''), chr(10)) AS kept FROM documents")
def remove_template_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.remove_template_lines(F.replace("text", F.lit(". "), F.lit(".\n{{x}}  "))).alias("kept"))


@register.query(f"SELECT doc_id, {sql_slug('text')} AS slug, {sql_slug('text')} || '.md' AS file_name FROM documents")
def slugify(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"), text.safe_filename(F.col("text"), "md").alias("file_name"))


@register.query(f"SELECT p_partkey, {sql_title('replace(lower(p_type) || chr(95) || p_name || chr(95) || lower(p_brand), chr(95), chr(32))')} AS label FROM part")
def label_titlecase(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.label(F.concat_ws("_", F.lower("p_type"), "p_name", F.lower("p_brand"))).alias("label"))


@register.query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type WHEN p_partkey % 3 = 1 THEN p_name ELSE p_type END AS name FROM part),
s AS (SELECT p_partkey, name, list_filter(string_split(name, ' '), lambda x: x <> '') AS p FROM n),
f AS (SELECT p_partkey, name, CASE WHEN len(p) > 1 THEN list_concat([p[1] || ' ' || p[-1], left(p[1], 1) || '. ' || p[-1]],
  CASE WHEN len(p) > 2 THEN [left(p[1], 1) || '. ' || array_to_string(list_transform(p[2:-2], lambda m: left(m, 1) || '.'), ' ') || ' ' || p[-1]] ELSE [] END) ELSE [] END AS a FROM s)
SELECT p_partkey, name, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x <> name))), ', ') AS aliases FROM f""")
def name_aliases(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    named = table(spark, folder, "part").select("p_partkey", F.when(k == 0, F.concat_ws(" ", "p_name", "p_type")).when(k == 1, F.col("p_name")).otherwise(F.col("p_type")).alias("name"))
    return named.select("p_partkey", "name", F.array_join(text.name_aliases(F.col("name")), ", ").alias("aliases"))


@register.query(f"""SELECT conv_id, turn, {sql_strip("translate('\"' || text || ''' ', '''\"', '')")} AS query FROM conversations WHERE role <> 'system' AND length({sql_strip("text")}) BETWEEN 1 AND 300""")
def query_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "conversations").filter((F.col("role") != "system") & F.length(text.strip(F.col("text"))).between(1, 300))
    return asked.select("conv_id", "turn", text.sanitize_query(F.concat(F.lit('"'), "text", F.lit("' "))).alias("query"))


def _acronyms(x: str) -> str:
    out = f"' ' || {x} || ' '"
    for short, name in ACRONYMS.items():
        for form in (short, short.lower()):
            out = f"replace({out}, ' {form} ', ' {name} ({short}) ')"
    return sql_strip(out)


@register.query(f"SELECT doc_id, {_acronyms('text')} AS expanded FROM documents")
def acronym_expand(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.expand_acronyms(F.col("text"), ACRONYMS).alias("expanded"))


@register.query(f"""
WITH s AS (SELECT doc_id, {sql_strip("text")} AS t FROM documents)
SELECT doc_id, CASE WHEN length(coalesce(t, '')) < 10 THEN 'Too little text for a description.' ELSE
  array_to_string(string_split(regexp_replace(t, '([.!?])[\\x{{9}}-\\x{{d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') END AS summary FROM s""".replace("\\\\", "\\"))
def summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@register.query(rf"""
WITH w AS (SELECT conv_id, turn, regexp_extract(text, '[^.!?] +(\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)+)', 1) AS names, list_distinct({sql_tokens("text")}) AS t FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, names, t, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS w FROM w),
r AS (SELECT conv_id, turn, names, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(w) DESC, w) AS k FROM e)
SELECT conv_id, turn, CASE WHEN names <> '' THEN names ELSE coalesce(string_agg(w, ' ' ORDER BY k), '') END AS keywords FROM r WHERE k <= 3 GROUP BY conv_id, turn, names""")
def keyword_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").filter("role = 'user'").select("conv_id", "turn", text.keywords(F.col("text")).alias("keywords"))


@register.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS none FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    get = lambda p: F.get_json_object("props", p)
    return table(spark, folder, "events").select("event_id", get("$.k").cast("bigint").alias("k"), F.coalesce(get("$.none"), F.lit("absent")).alias("none"))


_BIB = "'@article{key' || p_partkey || ', title = {' || p_name || '  of' || chr(10) || ' ' || p_type || '}, author = {' || p_brand || ' and Other}, Year = ' || (1990 + p_size) || ', pages = {1--' || p_size || '}, note = {}, year = {' || p_size || '}}'"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    entry = F.concat(F.lit("@article{key"), F.col("p_partkey").cast("string"), F.lit(", title = {"), "p_name", F.lit("  of\n "), "p_type", F.lit("}, author = {"), "p_brand", F.lit(" and Other}, Year = "), (F.col("p_size") + 1990).cast("string"), F.lit(", pages = {1--"), F.col("p_size").cast("string"), F.lit("}, note = {}, year = {"), F.col("p_size").cast("string"), F.lit("}}"))
    return table(spark, folder, "part").select("p_partkey", text.bibtex_fields(entry).alias("m"))


@register.query(f"""
WITH e AS (SELECT p_partkey, p_size, {_BIB} AS b FROM part)
SELECT p_partkey, regexp_extract(b, '@(\\w+)', 1) AS type, regexp_extract(b, '@\\w+\\{{([^,]+)', 1) AS citation_key, regexp_replace(regexp_extract(b, 'title = \\{{([^}}]*)', 1), '\\s+', ' ', 'g') AS title, regexp_extract(b, 'author = \\{{([^}}]*)', 1) AS author, CAST(p_size AS VARCHAR) AS year,
  regexp_extract(b, 'pages = \\{{([^}}]*)', 1) AS pages, CAST(NULL AS VARCHAR) AS note FROM e""")
def bibtex_parse(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("m")
    return _entries(spark, folder).select("p_partkey", *[F.element_at(m, k).alias(k) for k in ("type", "citation_key", "title", "author", "year", "pages", "note")])


@register.query("""
SELECT p_partkey, array_to_string(['**Type:** Journal Article', '**Authors:** ' || p_brand || ', Other', '**Title:** ' || p_name || ' of ' || p_type, '**Year:** ' || p_size, '**Pages:** 1-' || p_size, '**Citation Key:** `key' || p_partkey || '`'], chr(10)) AS markdown FROM part""")
def bibtex_render(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, folder).select("p_partkey", text.bibtex_markdown(F.col("m")).alias("markdown"))


@register.query(r"""
SELECT event_id, '# Log' || chr(10) || chr(10) || chr(10) || '**Event Type:** ' || event_type || chr(10) || '**Ok:** ' || CASE WHEN event_type = 'error' THEN '✗ No' ELSE '✓ Yes' END
  || chr(10) || '**Nothing:** *None*' || chr(10) || '**Tags:**' || chr(10) || '  - a' || chr(10) || '  - ' || event_type || chr(10) || '**Props:**' || chr(10) || '  **K:** ' || json_extract_string(props, '$.k') AS markdown FROM events""")
def json_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    value = F.concat(F.lit('{"event_type": "'), "event_type", F.lit('", "ok": '), (F.col("event_type") != "error").cast("string"), F.lit(', "nothing": null, "tags": ["a", "'), "event_type", F.lit('"], "props": '), "props", F.lit("}"))
    return table(spark, folder, "events").select("event_id", render.json_to_markdown(value, F.lit("Log")).alias("markdown"))


@register.query(f"""
WITH d AS (SELECT doc_id, lang, source, {sql_strip("text")} AS t FROM documents)
SELECT doc_id, array_to_string([array_to_string(['---', 'title: Document "' || doc_id || '"', 'date: ' || CASE WHEN doc_id % 2 = 0 THEN 'Unknown Date' ELSE lang END, 'source: ' || source, 'url: /d/' || doc_id, '---'], chr(10)),
  CASE WHEN doc_id % 3 = 0 THEN '![Image not found](No image)' ELSE '![Document "' || doc_id || '"](/i.png "Document \\"' || doc_id || '\\"")' END, '*Published: ' || CASE WHEN doc_id % 2 = 0 THEN 'Unknown Date' ELSE lang END || '*', coalesce(t, ''), '---' || chr(10) || chr(10)], chr(10) || chr(10)) AS entry FROM d""".replace("\\\\", "\\"))
def news_render(spark: SparkSession, folder: str) -> DataFrame:
    title = F.concat(F.lit('Document "'), F.col("doc_id").cast("string"), F.lit('"'))
    date = F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("lang"))
    image = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("/i.png"))
    return table(spark, folder, "documents").select("doc_id", render.news_entry(title, date, image, F.col("text"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")), F.col("source")).alias("entry"))


@register.query(r"""
SELECT doc_id, replace(regexp_replace('a:' || text || '?"x"', '[\\/:*?"<>|]', '_', 'g'), ' ', '_') AS file_name, left(text, 7) AS short_sha,
  CASE WHEN lang = 'en' THEN source ELSE 'enriched_' || source END AS file, left(text, 3000) AS excerpt FROM documents""")
def names_and_cuts(spark: SparkSession, folder: str) -> DataFrame:
    file = F.concat(F.lit("enriched_"), F.when(F.col("lang") != "en", F.lit("enriched_")).otherwise(F.lit("")), "source")
    return table(spark, folder, "documents").select("doc_id", text.filename(F.concat(F.lit("a:"), "text", F.lit('?"x"'))).alias("file_name"), text.short_sha(F.col("text")).alias("short_sha"), text.strip_prefix(file).alias("file"), text.truncate(F.col("text"), 3000).alias("excerpt"))


@register.query(f"""
SELECT doc_id, {sql_strip("replace(replace(replace(regexp_replace('<p>' || text || ' &amp; <b>x</b>&nbsp;</p>', '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&quot;', chr(34)), '&amp;', '&')")} AS inline,
  {sql_strip("replace(replace(replace(replace('<p>' || text || '<br>x<br />y</p>', '<p>', ''), '</p>', ''), '<br>', chr(10)), '<br />', chr(10))")} AS description FROM documents""")
def strip_tags(spark: SparkSession, folder: str) -> DataFrame:
    wrap = lambda tail: F.concat(F.lit("<p>"), "text", F.lit(tail))
    return table(spark, folder, "documents").select("doc_id", text.strip_inline(wrap(" &amp; <b>x</b>&nbsp;</p>")).alias("inline"), text.plain_description(wrap("<br>x<br />y</p>")).alias("description"))
