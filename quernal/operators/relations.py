"""Relational steps of enrichment: lookups with defaults, anti joins, flattening and first-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_GROUP, NO_DESCRIPTION = "No associated group.", "Description not available."
MEMBER = "Associated researcher."


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each value of keys, the first by order. Sorting is left out: partial aggregates keep one row a key on each side of the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")


def user_groups(users: DataFrame, groups: DataFrame) -> DataFrame:
    """user_name, user_description, group_acronym, group_name, group_description: a row for each user and group, one row of None for users without.

    users(user_name, user_description, groups ARRAY<STRUCT<acronym, name>>), groups(acronym, description).
    """
    each = users.select("user_name", "user_description", F.explode_outer("groups").alias("g"))
    key = F.lower("g.acronym")
    found = each.join(groups.select(F.col("acronym").alias("__a"), "description"), key == F.col("__a"), "left")
    none = F.col("g").isNull()
    described = F.when(none, NO_GROUP).otherwise(F.coalesce("description", F.lit(NO_DESCRIPTION)))
    return found.select("user_name", "user_description", F.when(none, "None").otherwise(key).alias("group_acronym"), F.when(none, "None").otherwise(F.coalesce("g.name", F.lit(""))).alias("group_name"), described.alias("group_description"))


def group_members(relations: DataFrame) -> DataFrame:
    """group_acronym, n_members, members: ordered lines of each group."""
    line = F.concat(F.lit("- **"), "user_name", F.lit(":** "), "user_description")
    return relations.groupBy("group_acronym").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("members"))


def flatten_items(nested: Column) -> Column:
    """items[].data[] as one array."""
    return F.flatten(F.transform(nested, lambda g: F.coalesce(g["data"], F.array())))


def distinct_items(owners: DataFrame, owner: str, items: str = "items") -> DataFrame:
    """owner, pos and the item's fields: each owner's items once, by id, or by title where there is no id; ids and titles count as one set."""
    each = owners.select(owner, F.posexplode(flatten_items(F.col(items))).alias("pos", "i")).withColumn("k", F.coalesce(F.nullif(F.col("i.id"), F.lit("")), F.nullif(F.col("i.title"), F.lit(""))))
    return first_by(each.filter("k is not null"), [owner, "k"], ["pos"]).select(owner, "pos", "i.*")


def distinct_projects(owners: DataFrame, order: str, items: str = "items") -> DataFrame:
    """Every project once, the first by owner order and position; those without an id are dropped."""
    each = owners.select(F.col(order).alias("o"), F.posexplode(flatten_items(F.col(items))).alias("pos", "i")).withColumn("id", F.nullif(F.col("i.id"), F.lit("")))
    return first_by(each.filter("id is not null"), ["id"], ["o", "pos"]).select("i.*")


def with_items(users: DataFrame, items: DataFrame, user: str, owner: str, out: str) -> DataFrame:
    """users with an array of their items, empty where there are none; of repeated owners the last by position wins."""
    last = items.groupBy(F.col(owner).alias("__o")).agg(F.max_by("items", "pos").alias(out))
    return users.join(last, users[user] == F.col("__o"), "left").drop("__o").withColumn(out, F.coalesce(out, F.array().cast(last.schema[out].dataType)))


def project_members(members: DataFrame, people: DataFrame) -> DataFrame:
    """members(project, person) with name and bio, the default where the person isn't known."""
    return members.join(people.select(F.col("person").alias("__p"), "name", "bio"), members["person"] == F.col("__p"), "left").drop("__p").withColumns({"name": F.coalesce("name", F.lit("Unknown")), "bio": F.coalesce("bio", F.lit(MEMBER))})


def not_enriched(raw: DataFrame, enriched: DataFrame, name: str = "file_name") -> DataFrame:
    """Raw files of which there is no enriched version."""
    done = enriched.select(F.regexp_replace(name, "^enriched_", "").alias(name)).distinct()
    return raw.join(done, name, "left_anti")


def group_files(groups: DataFrame, files: DataFrame) -> DataFrame:
    """acronym, path: for each distinct acronym the first `<acronym>.md` by path."""
    acronyms = groups.select(F.lower("acronym").alias("acronym")).filter("acronym <> ''").distinct()
    named = files.select("path", F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.md$", "").alias("acronym"))
    return acronyms.join(named, "acronym").groupBy("acronym").agg(F.min("path").alias("path"))


def categories(c: Column, targets: list[str]) -> Column:
    """Starts with one of the targets; all pass where there are none."""
    out = F.lit(not targets)
    for t in targets:
        out = out | F.startswith(c, F.lit(t))
    return out


def numbered(df: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """df with pos from 0 in the order within `by`, and batch, its whole part by size."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("pos") / size))
