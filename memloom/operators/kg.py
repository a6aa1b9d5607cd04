"""A temporal knowledge graph: facts (subject, predicate, object) with days of validity as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import md5_prefix


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity_"), md5_prefix(F.lower(name), 12))


def triple_id() -> Column:
    return F.concat(F.lit("triple_"), md5_prefix(F.lower(F.concat_ws("|", "subject", "predicate", "object")), 16))


def _none(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _valid(as_of: Column) -> Column:
    """Closed at both ends, compared as text; an empty bound is open."""
    return (_none("valid_from") | (F.col("valid_from") <= as_of)) & (_none("valid_to") | (F.col("valid_to") >= as_of))


def query_entity(triples: DataFrame, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
    """Facts from and to an entity, whatever its case: a fact about itself comes twice.

    Without a day every fact counts as current, also one that has ended.
    """
    facts = triples if as_of is None else triples.where(_valid(F.lit(as_of)))
    sides = []
    for way, c in (("outgoing", "subject"), ("incoming", "object")):
        if direction in ("both", way):
            sides.append(facts.where(F.lower(c) == name.lower()).withColumn("direction", F.lit(way)))
    out = sides[0].unionAll(sides[1]) if len(sides) == 2 else sides[0]
    return out.withColumn("current", F.lit(True))


def timeline(triples: DataFrame, name: str | None = None) -> DataFrame:
    """Facts in order of their first day, undated ones first; current: without a last day."""
    facts = triples if name is None else triples.where((F.lower("subject") == name.lower()) | (F.lower("object") == name.lower()))
    return facts.withColumn("current", _none("valid_to")).orderBy(F.asc_nulls_first("valid_from"), "id")


def stats(triples: DataFrame) -> DataFrame:
    """One row: entities, triples, current, expired and the predicates, in one pass but for the entities."""
    entities = triples.select(entity_id(F.col("subject")).alias("e")).unionAll(triples.select(entity_id(F.col("object")))).agg(F.countDistinct("e").alias("entities"))
    facts = triples.agg(F.count("*").alias("triples"), F.count_if(_none("valid_to")).alias("current_facts"), F.sort_array(F.collect_set("predicate")).alias("p"))
    return entities.join(F.broadcast(facts)).select("entities", "triples", "current_facts", (F.col("triples") - F.col("current_facts")).alias("expired_facts"), F.array_join("p", ",").alias("predicates"))  # one row each


def invalidate(triples: DataFrame, ended: DataFrame) -> DataFrame:
    """ended (subject, predicate, object, ended): facts without a last day get it, whatever the case of their names."""
    e = ended.select(*(F.lower(c).alias(f"_{c[0]}") for c in ("subject", "predicate", "object")), F.col("ended").alias("_ended")).groupBy("_s", "_p", "_o").agg(F.min("_ended").alias("_ended"))
    same = (F.lower("subject") == F.col("_s")) & (F.lower("predicate") == F.col("_p")) & (F.lower("object") == F.col("_o"))
    end = F.when(F.col("valid_to").isNull(), F.coalesce("_ended", "valid_to")).otherwise(F.col("valid_to"))
    return triples.join(e, same, "left").select(*(end.alias(c) if c == "valid_to" else F.col(c) for c in triples.columns))


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log (seq, op: add_entity, add or invalidate, subject, predicate, object, type, date) -> entities, triples.

    The last write of an entity or fact replaces it whole: filing a fact files both ends as
    ``unknown`` and revives the fact; an invalidation only counts after the last such write.
    """
    adds = log.where("op = 'add'")
    ends = adds.select("seq", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("subject").alias("name")), F.struct(F.lit(2).alias("k"), F.col("object").alias("name")))).alias("e"), F.lit("unknown").alias("type"))
    named = log.where("op = 'add_entity'").select("seq", F.lit(0).alias("k"), F.col("subject").alias("name"), "type").unionAll(ends.select("seq", "e.k", "e.name", "type"))
    entities = named.withColumn("id", entity_id(F.col("name"))).groupBy("id").agg(F.max_by(F.struct("name", "type"), F.struct("seq", "k")).alias("e")).select("id", "e.name", "e.type")
    last = adds.withColumn("id", triple_id()).groupBy("id").agg(F.max_by(F.struct("seq", "subject", "predicate", "object", "date"), "seq").alias("t"))
    off = log.where("op = 'invalidate'").withColumn("id", triple_id()).select("id", F.col("seq").alias("off_seq"), F.col("date").alias("off"))
    facts = last.join(off, "id", "left")
    facts = facts.groupBy("id").agg(F.first("t").alias("t"), F.min_by("off", F.when(F.col("off_seq") > F.col("t.seq"), F.col("off_seq"))).alias("valid_to"))
    triples = facts.select("id", "t.subject", "t.predicate", "t.object", F.col("t.date").alias("valid_from"), "valid_to", F.lit(1.0).alias("confidence"))
    return entities, triples


def as_of_join(triples: DataFrame, days: DataFrame) -> DataFrame:
    """The facts that hold on each of a set of days (day, as text). The days are a bounded list of the caller's."""
    return triples.join(F.broadcast(days), _valid(F.col("day")))
