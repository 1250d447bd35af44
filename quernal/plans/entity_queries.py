"""Queries of the relational operators: customers stand for people, nations for groups, orders for projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernal.functions import render, text
from quernal.operators import observe
from quernal.operators import relations as rel
from quernal.plans.registry import Register
from quernal.session import table

register = Register()


@register.query("SELECT c_custkey, c_mktsegment FROM customer WHERE starts_with(c_mktsegment, 'BUILD') OR starts_with(c_mktsegment, 'MACH')")
def category_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").filter(rel.categories(F.col("c_mktsegment"), ["BUILD", "MACH"])).select("c_custkey", "c_mktsegment")


_GROUPS = """
g AS (SELECT lower(n_name) AS acronym, 'Works on ' || n_name AS description FROM nation),
u AS (SELECT c_custkey, c_name, 'In ' || c_mktsegment AS c, CASE WHEN c_custkey % 7 = 0 THEN 'New ' || n_name ELSE n_name END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT c_name AS user_name, c AS user_description, CASE WHEN c_custkey % 10 = 0 THEN 'None' ELSE lower(n_name) END AS group_acronym, CASE WHEN c_custkey % 10 = 0 THEN 'None' ELSE n_name END AS group_name,
  CASE WHEN c_custkey % 10 = 0 THEN 'No associated group.' ELSE coalesce(description, 'Description not available.') END AS group_description FROM u LEFT JOIN g ON acronym = lower(n_name))"""


def _relations(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    people = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # every seventh belongs to a group that nobody described, every tenth to none
    group = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("New "), "n_name")).otherwise(F.col("n_name"))
    member = F.when(F.col("c_custkey") % 10 != 0, F.array(F.struct(group.alias("acronym"), group.alias("name"))))
    users = people.select(F.col("c_name").alias("user_name"), F.concat(F.lit("In "), "c_mktsegment").alias("user_description"), member.alias("groups"))
    groups = nation.select(F.lower("n_name").alias("acronym"), F.concat(F.lit("Works on "), "n_name").alias("description"))
    return rel.user_groups(users, groups)


@register.query(f"WITH {_GROUPS} SELECT * FROM r")
def user_group_relation(spark: SparkSession, folder: str) -> DataFrame:
    return _relations(spark, folder)


@register.query(f"""WITH {_GROUPS}, m AS (SELECT group_acronym, CAST(count(*) AS BIGINT) AS n_members, string_agg('- **' || user_name || ':** ' || user_description, chr(10) ORDER BY '- **' || user_name || ':** ' || user_description) AS members FROM r GROUP BY group_acronym)
SELECT group_acronym, n_members, '# Group: ' || upper(group_acronym) || chr(10) || chr(10) || '**AI Short Description:** ' || group_acronym || chr(10) || chr(10) || '## Associated Researchers' || chr(10) || members || chr(10) || chr(10) || '## Original Content' || chr(10) || group_acronym AS page FROM m""")
def group_members(spark: SparkSession, folder: str) -> DataFrame:
    g = F.col("group_acronym")
    return rel.group_members(_relations(spark, folder)).select(g, "n_members", render.group_page(g, g, F.array("members"), g).alias("page"))


def _owned(spark: SparkSession, folder: str) -> DataFrame:
    """customer -> items: one group of all its orders; ids repeat by orders' priority, every tenth has none."""
    orders = table(spark, folder, "orders")
    key = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"))
    item = F.struct("o_orderkey", key.alias("id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 7).cast("string")).alias("title"))
    grouped = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return grouped.select("o_custkey", F.array(F.struct(F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["o_orderkey"].alias("n"))).alias("data"))).alias("items"))


_ITEMS = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority || '/' || o_orderstatus END AS id, 'T' || (o_orderkey % 7) AS title, o_orderkey AS n FROM orders"


@register.query(f"WITH i AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, coalesce(id, title) ORDER BY pos) AS k FROM i) SELECT o_custkey, CAST(pos AS INTEGER) AS pos, id, title, n FROM r WHERE k = 1")
def nested_flatten_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rel.distinct_items(_owned(spark, folder), "o_custkey")


@register.query(f"WITH i AS ({_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_custkey, pos) AS k FROM i WHERE id IS NOT NULL) SELECT id, title, n FROM r WHERE k = 1")
def unique_projects(spark: SparkSession, folder: str) -> DataFrame:
    return rel.distinct_projects(_owned(spark, folder), "o_custkey")


@register.query("""
WITH m AS (SELECT DISTINCT l_orderkey, CASE WHEN l_suppkey % 5 = 0 THEN -l_suppkey ELSE l_suppkey END AS l_suppkey FROM lineitem),
p AS (SELECT l_orderkey, coalesce(s_name, 'Unknown') AS name, coalesce('Account in nation ' || s_nationkey, 'Associated researcher.') AS bio FROM m LEFT JOIN supplier ON s_suppkey = l_suppkey),
a AS (SELECT l_orderkey, string_agg('- **' || name || '**: ' || bio, chr(10) ORDER BY '- **' || name || '**: ' || bio) AS members FROM p GROUP BY l_orderkey)
SELECT o_orderkey, '## Order ' || o_orderkey || chr(10) || '**Status:** ' || o_orderstatus || chr(10) || '**Description:** ' || o_orderpriority || chr(10) || CASE WHEN members IS NULL THEN '' ELSE chr(10) || '### Associated Members' || chr(10) || members END
  || chr(10) || chr(10) || repeat('-', 80) || chr(10) AS page FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def project_members(spark: SparkSession, folder: str) -> DataFrame:
    members = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("project"), F.when(F.col("l_suppkey") % 5 == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).alias("person")).distinct()
    people = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"), F.concat(F.lit("Account in nation "), F.col("s_nationkey").cast("string")).alias("bio"))
    lines = rel.project_members(members, people).groupBy("project").agg(F.array_sort(F.collect_list(F.concat(F.lit("- **"), "name", F.lit("**: "), "bio"))).alias("lines"))
    orders = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("project"), "left")
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    page = render.project_page(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), {"Status": F.col("o_orderstatus")}, F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>")), lines)
    return orders.select("o_orderkey", page.alias("page"))


@register.query("""
WITH o AS (SELECT o_custkey, string_agg('- ' || o_orderkey, chr(10) ORDER BY '- ' || o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done, string_agg('- ' || o_orderkey, chr(10) ORDER BY '- ' || o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS open FROM orders GROUP BY o_custkey)
SELECT c_custkey, '## ' || c_name || chr(10) || '**Segment:** ' || c_mktsegment || chr(10) || chr(10) || '### Publications' || chr(10) || coalesce(done, '- No public records found.') || chr(10) || chr(10) || '### Projects' || chr(10) || coalesce(open, '- No projects found.') || chr(10) || chr(10) || repeat('-', 80) || chr(10) AS page
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def profile_render(spark: SparkSession, folder: str) -> DataFrame:
    """Finished orders stand for publications, the others for projects."""
    empty = F.array().cast("array<string>")
    line = F.concat(F.lit("- "), F.col("o_orderkey").cast("string"))
    lines = lambda c: F.array_sort(F.collect_list(F.when(c, line)))
    finished = F.col("o_orderstatus") == "F"
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(lines(finished).alias("done"), lines(~finished).alias("open"))
    users = table(spark, folder, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    page = render.profile(F.col("c_name"), text.name_aliases(F.col("c_name")), {"Segment": F.col("c_mktsegment")}, empty, F.coalesce("done", empty), F.coalesce("open", empty))
    return users.select("c_custkey", page.alias("page"))


@register.query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def user_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each person with the items of the last list that there is under its key; none for those without a list."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("items"), F.lit(0).alias("pos"))
    return rel.with_items(table(spark, folder, "customer"), orders, "c_custkey", "o_custkey", "lines").select("c_custkey", F.size("lines").cast("bigint").alias("n_items"))


@register.query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def file_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("file_name"))
    enriched = table(spark, folder, "labels").select(F.concat(F.lit("enriched_"), F.col("doc_id").cast("string")).alias("file_name"))
    return rel.not_enriched(raw, enriched).select("doc_id", "source")


@register.query("""
WITH a AS (SELECT DISTINCT lower(n_name) AS acronym FROM nation UNION SELECT 'none'), f AS (SELECT 'z/' || n_name || '.md' AS path FROM nation UNION ALL SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'a/' ELSE 'zz/' END || lower(n_name) || '.md' FROM nation)
SELECT acronym, min(path) AS path FROM a JOIN f ON regexp_replace(lower(string_split(path, '/')[-1]), '[.]md$', '') = acronym GROUP BY acronym""")
def distinct_acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every group has two files, in one order or the other; one more acronym has none."""
    nation = table(spark, folder, "nation")
    second = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "a/").otherwise("zz/"), F.lower("n_name"), F.lit(".md"))
    files = nation.select(F.concat(F.lit("z/"), "n_name", F.lit(".md")).alias("path")).unionByName(nation.select(second.alias("path")))
    return rel.group_files(nation.select(F.col("n_name").alias("acronym")).union(spark.sql("SELECT 'None' AS acronym")), files)


@register.query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def transcript(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").filter("role <> 'system'")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return said.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(ordered, lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("transcript"))


@register.query("""
SELECT event_type, CAST(count(*) AS BIGINT) AS n_events, CAST(count(*) FILTER (WHERE value IS NULL OR value < 1) AS BIGINT) AS n_failed, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS duration_us,
  bool_and(value >= 0) AS all_ok, array_to_string(list_sort(array_agg(event_id) FILTER (WHERE value IS NULL OR value < 1))[1:10], ',') AS first_failed FROM events GROUP BY event_type""")
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    return observe.run_report(table(spark, folder, "events"), "event_type", F.coalesce(F.col("value") < 1, F.lit(True)))


@register.query("""
SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return observe.windows(table(spark, folder, "events"))


@register.query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT event_id, user_id, CAST(pos AS INTEGER) AS pos, CAST(pos // 20 AS BIGINT) AS batch FROM r""")
def batches(spark: SparkSession, folder: str) -> DataFrame:
    return rel.numbered(table(spark, folder, "events"), ["ts", "event_id"], 20, ["user_id"]).select("event_id", "user_id", "pos", "batch")


@register.query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS k FROM o WHERE k <= 3""")
def latest_items(spark: SparkSession, folder: str) -> DataFrame:
    """The feature is the limit: the first n items of each owner."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).filter("k <= 3")
