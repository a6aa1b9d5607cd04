"""Drawers: filed texts with flat, typed metadata. Every operator takes and returns DataFrames.

A drawers table has drawer_id, wing, room, content, source_file, added_by, created_at (epoch
seconds), extra (map of further metadata as text), extra_type (map: string, number or
boolean) and ord, the order of filing, which breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import basename, col, epoch_of, iso_utc, md5_prefix, snippet

#: Metadata that a caller can't set when filing, and when updating.
RESERVED_ON_ADD = ("wing", "room", "created_at", "filed_at")
RESERVED_ON_UPDATE = ("created_at", "filed_at")


def within(wing: str | None = None, room: str | None = None) -> Column:
    """Any number of equality filters; none is always true."""
    cond = F.lit(True)
    if wing:
        cond = cond & (F.col("wing") == wing)
    if room:
        cond = cond & (F.col("room") == room)
    return cond


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("unknown")).alias(c)


def status(drawers: DataFrame) -> DataFrame:
    """(level, key, drawers): the total, and the count of each wing and room, in one pass."""
    sets = drawers.select(_known("wing"), _known("room")).groupingSets([[F.col("wing")], [F.col("room")], []], "wing", "room").agg(F.count("*").alias("drawers"), F.grouping_id("wing", "room").alias("g"))
    level = F.when(F.col("g") == 1, "wing").when(F.col("g") == 2, "room").otherwise("total")
    return sets.select(level.alias("level"), F.coalesce("wing", "room", F.lit("")).alias("key"), "drawers")


def list_wings(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy(_known("wing")).agg(F.count("*").alias("drawers"))


def list_rooms(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    return drawers.where(within(wing)).groupBy(_known("room")).agg(F.count("*").alias("drawers"))


def taxonomy(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy(_known("wing"), _known("room")).agg(F.count("*").alias("drawers"))


def get_drawer(drawers: DataFrame, drawer_id: str) -> DataFrame:
    return drawers.where(F.col("drawer_id") == drawer_id)


def query_by_metadata(drawers: DataFrame, key: str, value: str, *, wing: str | None = None, room: str | None = None, limit: int = 50) -> DataFrame:
    """Drawers whose text metadata has that value; numbers and booleans never equal a text."""
    same = (F.element_at("extra", F.lit(key)) == value) & (F.element_at("extra_type", F.lit(key)) == "string")
    return drawers.where(same & within(wing, room)).orderBy("ord").limit(limit)


def query_by_date(drawers: DataFrame, after: str | None = None, before: str | None = None, *, wing: str | None = None, room: str | None = None, limit: int = 50) -> DataFrame:
    """Drawers filed in the closed interval, the latest first; text that is no time raises."""
    cond = within(wing, room)
    if after:
        cond = cond & (F.col("created_at") >= epoch_of(F.lit(after)))
    if before:
        cond = cond & (F.col("created_at") <= epoch_of(F.lit(before)))
    return drawers.where(cond).orderBy(F.coalesce("created_at", F.lit(0.0)).desc(), "ord").limit(limit)


def recall(drawers: DataFrame, wing: str | None = None, room: str | None = None, n: int = 10) -> DataFrame:
    """The first n drawers of a wing and room, as lines of text."""
    some = drawers.where(within(wing, room)).orderBy("ord").limit(n)
    line = F.concat(F.lit("  ["), F.coalesce("room", F.lit("?")), F.lit("] "), snippet("content", 300), F.coalesce(F.concat(F.lit("  ("), basename("source_file"), F.lit(")")), F.lit("")))
    return some.select("ord", "drawer_id", line.alias("line"))


def lexical_search(drawers: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Containing the query, whatever its case, is distance 0.1, else 0.9."""
    distance = F.when(F.contains(F.lower("content"), F.lower(F.lit(query))), 0.1).otherwise(0.9)
    return drawers.select("drawer_id", "ord", distance.alias("distance")).orderBy("distance", "ord").limit(n)


def flatten_metadata(value: Column, kind: Column) -> Column:
    """Metadata as filed: text, numbers and booleans stay, anything else becomes its JSON text."""
    return F.when(kind.isin("string", "number", "boolean"), value).otherwise(F.coalesce(value, F.lit("null")))


def drawer_id(wing: Column | str, room: Column | str, key: Column) -> Column:
    return F.concat(F.lit("drawer_"), col(wing), F.lit("_"), col(room), F.lit("_"), md5_prefix(key, 16))


def add_drawers(drawers: DataFrame, new: DataFrame, *, now: float) -> DataFrame:
    """The drawers and new ones (wing, room, content, source_file, added_by, extra, extra_type, ord), stamped with now.

    Reserved keys in extra are left out. Ids follow from the first 100 characters and the time.
    """
    stamp = iso_utc(F.lit(float(now)))
    kept = lambda m: F.map_filter(m, lambda k, _: ~k.isin(*RESERVED_ON_ADD))
    made = new.select(
        drawer_id("wing", "room", F.concat(F.substring("content", 1, 100), stamp)).alias("drawer_id"),
        "wing",
        "room",
        "content",
        "source_file",
        F.coalesce("added_by", F.lit("mcp")).alias("added_by"),
        F.lit(float(now)).alias("created_at"),
        kept(F.col("extra")).alias("extra"),
        kept(F.col("extra_type")).alias("extra_type"),
        "ord",
    )
    return drawers.unionByName(made, allowMissingColumns=True)


def update_drawers(drawers: DataFrame, updates: DataFrame, *, now: float) -> DataFrame:
    """Partial updates (drawer_id, content, wing, room, extra: null leaves as is). Ids stay, also when wing or room change."""
    u = updates.select("drawer_id", F.col("content").alias("_content"), F.col("wing").alias("_wing"), F.col("room").alias("_room"), F.col("extra").alias("_extra"), F.lit(True).alias("_hit"))
    fresh = F.map_filter(F.coalesce("_extra", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*RESERVED_ON_UPDATE))
    old = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    joined = drawers.join(u, "drawer_id", "left")
    changed = {
        "content": F.coalesce("_content", "content"),
        "wing": F.coalesce("_wing", "wing"),
        "room": F.coalesce("_room", "room"),
        "extra": F.when(F.col("_extra").isNotNull(), F.map_concat(old, fresh)).otherwise(F.col("extra")),
    }
    keep = [changed[c].alias(c) if c in changed else F.col(c) for c in drawers.columns]
    return joined.select(*keep, F.when(F.col("_hit"), F.lit(float(now))).alias("updated_at"))


def delete_drawers(drawers: DataFrame, ids: DataFrame) -> DataFrame:
    return drawers.join(ids.select("drawer_id"), "drawer_id", "left_anti")


def latest_version(log: DataFrame, key: str, order: str) -> DataFrame:
    """Of an append-only log, the last row of each key: how updates read where tables can only grow."""
    last = log.groupBy(key).agg(F.max(order).alias(order))
    return log.join(last, [key, order], "left_semi")


def already_filed(files: DataFrame, drawers: DataFrame) -> DataFrame:
    """Files (path, ...) from which no drawer came yet."""
    filed = drawers.select(F.col("source_file").alias("path"))
    return files.join(filed, "path", "left_anti")


def diary_entries(entries: DataFrame) -> DataFrame:
    """entries (agent, topic, entry, filed_at, ord) as drawers of the agent's own wing, room ``diary``."""
    wing = F.concat(F.lit("wing_"), F.replace(F.lower("agent"), F.lit(" "), F.lit("_")))
    stamp = F.substring(F.regexp_replace("filed_at", "[:.]", ""), 1, 15)
    return entries.select(
        F.concat(F.lit("diary_"), wing, F.lit("_"), stamp, F.lit("_"), md5_prefix(F.substring("entry", 1, 50), 8)).alias("drawer_id"),
        wing.alias("wing"),
        F.lit("diary").alias("room"),
        F.lit("hall_diary").alias("hall"),
        F.lit("diary_entry").alias("type"),
        "agent",
        "topic",
        F.substring("filed_at", 1, 10).alias("date"),
        "filed_at",
        F.col("entry").alias("content"),
        "ord",
    )


def diary_read(entries: DataFrame, last_n: int = 10) -> DataFrame:
    """Each agent's last entries, the latest first, with the agent's total."""
    per = Window.partitionBy("agent")
    nth = F.row_number().over(per.orderBy(F.desc("filed_at"), "ord"))
    ranked = entries.withColumn("nth", nth).where(F.col("nth") <= last_n)
    totals = entries.groupBy("agent").agg(F.count("*").alias("total"))
    return ranked.join(totals, "agent")
