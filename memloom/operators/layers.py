"""Context in layers: identity, the essential story, recall on demand and deep search."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import basename, snippet, token_estimate
from memloom.operators.drawers import within

MOST_DRAWERS, MOST_CHARS = 15, 3200
IDENTITY_TITLE, STORY_TITLE = "## L0 — SOUL (Who am I?)", "## L1 — ESSENTIAL STORY"
MORE = "  ... (more in L3 search)"


def load_identity(paths: Iterable[str | Path]) -> str:
    """The first of the files that has text."""
    for path in paths:
        try:
            if text := Path(path).read_text(encoding="utf-8").strip():
                return f"{IDENTITY_TITLE}\n{text}"
        except OSError:
            continue
    return f"{IDENTITY_TITLE}\nNo identity configured."


def importance() -> F.Column:
    """The first of three metadata keys that is there, as a number; 3 if it is none. Empty text is 0 and true is 1."""
    first = F.coalesce(*(F.try_element_at("extra", F.lit(k)) for k in ("importance", "emotional_weight", "weight")))
    kind = F.coalesce(*(F.when(F.try_element_at("extra", F.lit(k)).isNotNull(), F.try_element_at("extra_type", F.lit(k))) for k in ("importance", "emotional_weight", "weight")))
    number = F.when(F.trim(first) == "", 0.0).when((kind == "boolean") & (first == "true"), 1.0).when((kind == "boolean") & (first == "false"), 0.0).otherwise(F.trim(first).try_cast("double"))
    return F.when(F.isnan(number), F.lit(3.0)).otherwise(F.coalesce(number, F.lit(3.0)))


def most_important(drawers: DataFrame, wing: str | None = None, n: int = MOST_DRAWERS) -> DataFrame:
    """The n drawers of greatest importance, earlier ones first among equals."""
    some = drawers.where(within(wing) & (F.col("content") != ""))
    return some.select("ord", F.coalesce("room", F.lit("general")).alias("room"), "content", "source_file", importance().alias("importance")).orderBy(F.desc("importance"), "ord").limit(n)


def story_lines(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    """(nth, line): the lines of the essential story after its title, up to the first that goes beyond the budget.

    Windows are over at most MOST_DRAWERS rows.
    """
    top = most_important(drawers, wing)
    sort_key = F.concat("room", F.lit(","))
    within_room = Window.partitionBy("room").orderBy(F.desc("importance"), "ord")
    entry = F.concat(F.lit("  - "), snippet("content", 200), F.coalesce(F.concat(F.lit("  ("), basename("source_file"), F.lit(")")), F.lit("")))
    rows = top.select(sort_key.alias("k"), "room", F.row_number().over(within_room).alias("i"), entry.alias("line"))
    heads = rows.where("i = 1").select("k", "room", F.lit(0).alias("i"), F.concat(F.lit("\n["), "room", F.lit("]")).alias("line"))
    both = rows.unionAll(heads)
    upto = Window.orderBy("k", "i")
    both = both.withColumn("used", F.sum(F.length("line")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("i") > 0) & (F.col("used") > MOST_CHARS)
    both = both.withColumn("overs", F.sum(over.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("first_over", (F.col("overs") == 1) & over)
    kept = both.where((F.col("overs") == 0) | F.col("first_over"))
    return kept.select(F.row_number().over(Window.orderBy("k", "i")).cast("long").alias("nth"), F.when(F.col("first_over"), F.lit(MORE)).otherwise(F.col("line")).alias("line"))


def essential_story(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    """One row: the story as text."""
    lines = F.array_sort(F.collect_list(F.struct("nth", "line")))  # twice MOST_DRAWERS at most
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    story = story_lines(drawers, wing).agg(F.count("*").alias("n"), text.alias("body"))
    return story.select(F.when(F.col("n") > 0, F.concat(F.lit(f"{STORY_TITLE}\n"), "body")).otherwise(F.lit("## L1 — No memories yet.")).alias("story"))


def wake_up(drawers: DataFrame, identity: str, wing: str | None = None) -> DataFrame:
    """One row: identity and story, with the estimate of their tokens."""
    text = F.concat(F.lit(f"{identity}\n\n"), "story")
    return essential_story(drawers, wing).select(text.alias("text"), token_estimate(text).alias("tokens"))


def layer_status(drawers: DataFrame, identity: str) -> DataFrame:
    return drawers.agg(F.count("*").alias("total_drawers")).select("total_drawers", token_estimate(F.lit(identity)).alias("identity_tokens"))


def deep_search_lines(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, similarity, wing, room, content, source_file) -> (query_id, rank, text)."""
    head = F.concat(F.lit("  ["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("wing", F.lit("?")), F.lit("/"), F.coalesce("room", F.lit("?")), F.lit(" (sim="), F.col("similarity").cast("string"), F.lit(")"))
    source = F.concat(F.lit("      src: "), basename("source_file"))
    return hits.select("query_id", "rank", F.concat_ws("\n", head, F.concat(F.lit("      "), snippet("content", 300)), source).alias("text"))
