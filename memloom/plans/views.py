"""The engine's tables derived from the driver's, and the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import md5_prefix

NAMES = ["Alice", "Bob", "Riley", "Grace", "Jordan", "Maxwell"]
PROJECTS = ["Atlas", "Nimbus", "Quartz"]
TEMPLATES = [
    "{U} said we decided to deploy the server because the old api failed.",
    "Hey {U}, the roadmap and the sprint deadline moved. I am worried about scope.",
    "We chose {P} instead of the alternative option and replaced the old approach.",
    "{U} asked if she could launch {P} v2 with the new module and interface layer.",
    "building {P}. {P}.py is broken and stuck, {U} wrote a workaround fix.",
    "The weather is nice today.",
    "{U} was excited and grateful: a breakthrough, the turning point of the core design!",
    "I saw {U} at the park. {U} told us that they love the plan.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a drawer: wing is its source, room its language."""
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    return docs.select(
        F.concat(F.lit("drawer_"), "source", F.lit("_"), "lang", F.lit("_"), md5_prefix(F.col("doc_id").cast("string"), 16)).alias("drawer_id"),
        F.col("source").alias("wing"),
        F.col("lang").alias("room"),
        F.col("text").alias("content"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.lit("loader").alias("added_by"),
        (F.lit(1704067200.0) + 60.0 * F.col("doc_id")).alias("created_at"),
        F.create_map(F.lit("importance"), F.col("quality").cast("string"), F.lit("size"), F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("extra"),
        F.create_map(F.lit("importance"), F.lit("number"), F.lit("size"), F.lit("string")).alias("extra_type"),
        F.col("doc_id").alias("ord"),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated facts from orders, undated ones from the nations of customers and suppliers."""
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    end = F.date_add(day, (F.col("o_orderkey") % 400).cast("int"))
    ordered = orders.select(
        F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("subject"),
        F.lit("ordered").alias("predicate"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("object"),
        F.date_format(day, "yyyy-MM-dd").alias("valid_from"),
        F.when(F.col("o_orderstatus") != "O", F.date_format(end, "yyyy-MM-dd")).alias("valid_to"),
    )
    nation = table(spark, sf_dir, "nation")
    undated = [F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")]
    out = ordered
    for name, key in (("customer", "c"), ("supplier", "s")):
        who = table(spark, sf_dir, name).join(F.broadcast(nation), F.col(f"{key}_nationkey") == F.col("n_nationkey"))  # 25 nations
        out = out.unionAll(who.select(F.concat(F.lit(f"{name.capitalize()}#"), F.col(f"{key}_{name[:4]}key").cast("string")), F.lit("located_in"), "n_name", *undated))
    region = table(spark, sf_dir, "region")
    part_of = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("part_of"), "r_name", *undated)
    out = out.unionAll(part_of)
    return out.withColumn("id", F.concat(F.lit("triple_"), md5_prefix(F.lower(F.concat_ws("|", "subject", "predicate", "object")), 16))).withColumn("confidence", F.lit(1.0)).withColumn("source_closet", F.lit(None).cast("string"))


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("agent"),
        F.col("event_type").alias("topic"),
        F.col("props").alias("entry"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("filed_at"),
        F.col("event_id").alias("ord"),
    )


def room_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order: its customer is the wing, its block of four order numbers the room, so that walks go deep."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("wing"), F.concat(F.lit("r"), F.floor(F.col("o_orderkey") / 4).cast("string")).alias("room"), F.col("o_orderkey").alias("ord"))


def _pick(values: list[str], at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence or two for each event, about people and projects."""
    return _notes(table(spark, sf_dir, "events"))


def _notes(events: DataFrame) -> DataFrame:
    text = _pick(TEMPLATES, F.col("event_id") % 8)
    text = F.replace(text, F.lit("{U}"), _pick(NAMES, F.col("user_id") % 6))
    text = F.replace(text, F.lit("{P}"), _pick(PROJECTS, F.col("user_id") % 3))
    return events.select(F.col("event_id").alias("note_id"), "user_id", text.alias("text"))


def spread_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes dealt over all cores for costly expressions: a file with few row groups is read by as few tasks."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return _notes(events.repartition(4 * spark.sparkContext.defaultParallelism, "event_id"))


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes, each of a user of its own."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("user_id"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("w"), (F.col("label") % 3).cast("string")).alias("wing"), F.col("label").cast("string").alias("room"), "embedding")


def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("conv_id", F.col("turn").alias("ord"), "role", "text")


_TEXT = "list_value(" + ", ".join(f"'{t}'" for t in TEMPLATES) + ")"
_LIST = lambda xs: "list_value(" + ", ".join(f"'{x}'" for x in xs) + ")"
SQL = {
    "drawers": """drawers AS (SELECT 'drawer_' || source || '_' || lang || '_' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS drawer_id, source AS wing, lang AS room,
      text AS content, '/corpus/' || source || '/doc' || doc_id || '.txt' AS source_file, 1704067200.0::DOUBLE + 60.0::DOUBLE * doc_id AS created_at, quality,
      CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size, doc_id AS ord FROM documents LEFT JOIN labels USING (doc_id))""",
    "triples": """triples AS (SELECT *, 'triple_' || substring(md5(lower(subject || '|' || predicate || '|' || object)), 1, 16) AS id FROM (
      SELECT 'Customer#' || o_custkey AS subject, 'ordered' AS predicate, 'order-' || o_orderkey AS object, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS valid_from,
        CASE WHEN o_orderstatus <> 'O' THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER), '%Y-%m-%d') END AS valid_to FROM orders
      UNION ALL SELECT 'Customer#' || c_custkey, 'located_in', n_name, NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 'Supplier#' || s_suppkey, 'located_in', n_name, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT n_name, 'part_of', r_name, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey))""",
    "diary": "diary AS (SELECT 'user_' || user_id AS agent, event_type AS topic, props AS entry, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS filed_at, event_id AS ord FROM events)",
    "room_graph": "room_graph AS (SELECT 'w' || o_custkey AS wing, 'r' || (o_orderkey // 4) AS room, o_orderkey AS ord FROM orders)",
    "notes": f"notes AS (SELECT event_id AS note_id, user_id, replace(replace({_TEXT}[event_id % 8 + 1], '{{U}}', {_LIST(NAMES)}[user_id % 6 + 1]), '{{P}}', {_LIST(PROJECTS)}[user_id % 3 + 1]) AS text FROM events)",
    "document_notes": "notes AS (SELECT doc_id AS note_id, doc_id AS user_id, coalesce(text, '') AS text FROM documents)",
    "vectors": "vectors AS (SELECT vec_id AS id, 'w' || (label % 3) AS wing, CAST(label AS VARCHAR) AS room, embedding FROM embeddings)",
    "conv_messages": "conv_messages AS (SELECT conv_id, turn AS ord, role, text FROM conversations WHERE role IN ('user', 'assistant'))",
}


def sql(names: str, body: str) -> str:
    """A query over the named views, and over further CTEs that body may begin with after ``WITH``."""
    ctes = ",\n".join(SQL[n] for n in names.split())
    body = body.strip()
    return f"WITH RECURSIVE {ctes}" + (",\n" + body[4:].lstrip() if body.upper().startswith("WITH") else "\n" + body)
