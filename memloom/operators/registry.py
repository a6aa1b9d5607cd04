"""A registry of people and projects: seeding, look-up, disambiguation, research and learning.

people has name, source, context, aliases (array), relationship, confidence, canonical and
ord (order of entry, which decides look-ups); projects has name and ord; flags has word;
wiki has word, inferred_type, confidence and confirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.lexicon import COMMON_WORDS, CONCEPT_CONTEXTS, NAME_PHRASES, PERSON_CONTEXTS, PLACE_PHRASES
from memloom.functions.text import LEFT, RIGHT, once, trim
from memloom.operators.entities import for_mark, marked, needed_word

#: Names and aliases that are broadcast; a larger registry meets the texts by shuffle.
MOST_NAMES = 50_000


def seed(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """people (name, relationship, context, ord), aliases (alias, canonical, ord) -> the registry's people.

    The last alias of a name counts; it gets a row of its own after the person's. A name
    that is given again keeps its first place and takes the last values. Blank names go.
    """
    alias = aliases.groupBy(F.col("canonical").alias("name")).agg(F.max_by("alias", "ord").alias("alias"))
    named = people.withColumn("name", trim("name")).where("name <> ''").join(alias, "name", "left")
    base = {"source": F.lit("onboarding"), "context": F.coalesce("context", F.lit("personal")), "relationship": F.coalesce("relationship", F.lit("")), "confidence": F.lit(1.0)}
    own = named.select("name", *(c.alias(n) for n, c in base.items()), F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>")).alias("aliases"), F.lit(None).cast("string").alias("canonical"), (2 * F.col("ord")).alias("ord"))
    other = named.where("alias is not null").select(F.col("alias").alias("name"), *(c.alias(n) for n, c in base.items()), F.array("name").alias("aliases"), F.col("name").alias("canonical"), (2 * F.col("ord") + 1).alias("ord"))
    row = F.struct("source", "context", "relationship", "confidence", "aliases", "canonical")
    return own.unionAll(other).groupBy("name").agg(F.max_by(row, "ord").alias("r"), F.min("ord").alias("ord")).select("name", "r.*", "ord")


def ambiguous_flags(people: DataFrame) -> DataFrame:
    return people.select(F.lower("name").alias("word")).where(F.col("word").isin(COMMON_WORDS)).distinct()


def context_scores(name: Column, context: Column) -> tuple[Column, Column]:
    """How many patterns around the name speak for a person, and for a concept."""
    text = marked(context, name)
    total = lambda ps: sum(((F.contains(text, F.lit(needed_word(p))) & text.rlike(for_mark(p))).cast("int") for p in ps), F.lit(0))
    return total(PERSON_CONTEXTS), total(CONCEPT_CONTEXTS)


def disambiguate(words: DataFrame) -> DataFrame:
    """words (word, context, ...) with person_score, concept_score, meaning (person, concept or null) and its confidence."""
    person, concept = context_scores(F.col("word"), F.col("context"))
    scored = once(words, {"person_score": person, "concept_score": concept})
    p, c = F.col("person_score"), F.col("concept_score")
    meaning = F.when(p > c, "person").when(c > p, "concept")
    sure = F.when(p > c, F.least(F.lit(0.95), 0.7 + p * 0.1)).when(c > p, F.least(F.lit(0.9), 0.7 + c * 0.1))
    return once(scored, {"meaning": meaning, "sure": sure})


def lookup(words: DataFrame, people: DataFrame, projects: DataFrame, wiki: DataFrame) -> DataFrame:
    """words (word_id, word, context) -> (word_id, word, type, confidence, source, name, disambiguated).

    People come first (by name or alias, the earliest entered), then projects, then
    confirmed research. A common word that is also a person's name is judged by its context.
    """
    names = people.select(F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("n"), "name", "source", "confidence", "ord")
    person = names.groupBy(F.lower("n").alias("key")).agg(F.min_by(F.struct("name", "source", "confidence"), "ord").alias("person"))
    project = projects.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "ord").alias("project"))
    known = wiki.where("confirmed").groupBy(F.lower("word").alias("key")).agg(F.min(F.struct("inferred_type", "confidence")).alias("wiki"))
    flags = ambiguous_flags(people).select(F.col("word").alias("key"), F.lit(True).alias("flagged"))
    met = disambiguate(words).withColumn("key", F.lower("word"))
    for side in (person, project, known, flags):
        met = met.join(side, "key", "left")
    judged = F.col("person").isNotNull() & F.coalesce("flagged", F.lit(False)) & (F.coalesce("context", F.lit("")) != "") & F.col("meaning").isNotNull()
    concept = judged & (F.col("meaning") == "concept")
    pick = lambda a, b, c, d, e: F.when(concept, a).when(judged, b).when(F.col("person").isNotNull(), c).when(F.col("project").isNotNull(), d).otherwise(e)
    found = F.col("wiki").isNotNull()
    return met.select(
        "word_id",
        "word",
        pick(F.lit("concept"), F.lit("person"), F.lit("person"), F.lit("project"), F.coalesce("wiki.inferred_type", F.lit("unknown"))).alias("type"),
        pick(F.col("sure"), F.col("sure"), F.col("person.confidence"), F.lit(1.0), F.coalesce("wiki.confidence", F.lit(0.0))).alias("confidence"),
        pick(F.lit("context_disambiguated"), F.col("person.source"), F.col("person.source"), F.lit("onboarding"), F.when(found, "wiki").otherwise("none")).alias("source"),
        pick(F.col("word"), F.col("word"), F.col("person.name"), F.col("project"), F.col("word")).alias("name"),
        judged.alias("disambiguated"),
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """pages (word, status, page_type, title, description, extract) -> (word, inferred_type, confidence, title, summary).

    What an encyclopaedia's page says of a word: none at all hints at a name.
    """
    text, word = F.lower(F.coalesce("extract", F.lit(""))), F.lower("word")
    any_of = lambda ps: F.array_contains(F.transform(F.array(*map(F.lit, ps)), lambda p: F.contains(text, p)), True)
    split = F.col("page_type") == "disambiguation"
    named = F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("name"))
    plain = F.contains(text, F.concat(word, F.lit(" is a"))) | F.contains(text, F.concat(word, F.lit(" (name")))
    ok = F.col("status") == 200
    rules = [
        (~ok & (F.col("status") == 404), "person", 0.7),
        (~ok, "unknown", 0.0),
        (split & named, "person", 0.65),
        (split, "ambiguous", 0.4),
        (any_of(NAME_PHRASES) & plain, "person", 0.9),
        (any_of(NAME_PHRASES), "person", 0.8),
        (any_of(PLACE_PHRASES), "place", 0.8),
    ]
    kind, sure = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for cond, k, s in rules:
        kind, sure = kind.when(F.coalesce(cond, F.lit(False)), k), sure.when(F.coalesce(cond, F.lit(False)), s)
    return pages.select("word", kind.otherwise("concept").alias("inferred_type"), sure.otherwise(0.6).alias("confidence"), F.when(ok, F.coalesce("title", "word")).alias("title"), F.when(ok, F.substring(text, 1, 200)).alias("summary"))


def research(words: DataFrame, wiki: DataFrame, pages: DataFrame) -> DataFrame:
    """The research table with the words that it lacks added, unconfirmed."""
    new = words.select("word").distinct().join(wiki.select("word"), "word", "left_anti")
    found = classify_pages(pages.join(new, "word", "left_semi"))
    return wiki.unionByName(found.withColumn("confirmed", F.lit(False)), allowMissingColumns=True)


def confirm(people: DataFrame, wiki: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """confirmed (word, entity_type, relationship, context): marks the research, and adds persons at 0.9."""
    mark = confirmed.select("word", F.lit(True).alias("_c"))
    wiki = wiki.join(mark, "word", "left").withColumn("confirmed", F.coalesce("_c", "confirmed")).drop("_c")
    last = people.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("_o"))
    new = confirmed.where("entity_type = 'person'").join(F.broadcast(last)).select(
        F.col("word").alias("name"), F.lit("wiki").alias("source"), F.coalesce("context", F.lit("personal")).alias("context"), F.coalesce("relationship", F.lit("")).alias("relationship"),
        F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("canonical"), (F.col("_o") + F.row_number().over(Window.orderBy("word"))).alias("ord"),
    )
    return people.join(new.select("name"), "name", "left_anti").unionByName(new), wiki


def learn(detected: DataFrame, people: DataFrame, projects: DataFrame, *, mode: str = "personal", least: float = 0.75) -> DataFrame:
    """detected (name, frequency, type, confidence) -> new people rows: sure persons that the registry doesn't have by that very name."""
    new = detected.where((F.col("type") == "person") & (F.col("confidence") >= least))
    new = new.join(people.select("name"), "name", "left_anti").join(projects.select("name"), "name", "left_anti")
    return new.groupBy("name").agg(F.max("confidence").alias("confidence"), F.max("frequency").alias("seen_count")).select("name", F.lit("learned").alias("source"), F.lit("personal" if mode == "combo" else mode).alias("context"), "confidence", "seen_count")


def people_in(queries: DataFrame, people: DataFrame) -> DataFrame:
    """queries (query_id, text) -> (query_id, name): people whose name or alias is in the text, common words only where the context says so."""
    flags = ambiguous_flags(people).select(F.col("word").alias("_w"), F.lit(True).alias("flagged"))
    first = F.regexp_extract(F.lower("word"), "[a-z0-9_]+", 0)  # a word of the name that the text must have: an equi-join
    names = people.select("name", F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("word")).join(flags, F.lower("word") == F.col("_w"), "left").withColumn("token", first)
    words = queries.select("query_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1)))).alias("token"))
    few = names.limit(MOST_NAMES + 1).count() <= MOST_NAMES
    met = words.join(F.broadcast(names) if few else names.hint("merge"), "token")  # said outright: the words of all texts look small to the planner, as it knows the file's size only
    whole = F.rlike("text", F.concat(F.lit("(?i)" + LEFT), F.regexp_replace("word", r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(RIGHT)))
    judged = disambiguate(met.where(whole).withColumn("context", F.col("text")))
    return judged.where(F.col("flagged").isNull() | (F.col("meaning") == "person")).select("query_id", "name").distinct()


def unknown_words(queries: DataFrame, people: DataFrame, projects: DataFrame, wiki: DataFrame) -> DataFrame:
    """queries (query_id, text) -> (query_id, word): capitalised words that are not common and that nothing here knows."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"{LEFT}([A-Z][a-z]{{2,15}}){RIGHT}"), F.lit(1)))).alias("word"))
    known = people.select(F.explode(F.concat(F.array("name"), F.col("aliases"))).alias("key")).select(F.lower("key").alias("key")).unionAll(projects.select(F.lower("name"))).unionAll(wiki.where("confirmed").select(F.lower("word"))).distinct()
    return words.where(~F.lower("word").isin(COMMON_WORDS)).withColumn("key", F.lower("word")).join(known, "key", "left_anti").select("query_id", "word")


def summary(people: DataFrame, projects: DataFrame, wiki: DataFrame, mode: str = "personal") -> DataFrame:
    """One row of text: counts, the first eight people, the projects and the flags."""
    first = F.sort_array(F.collect_list(F.struct("ord", "name")))
    names = people.orderBy("ord", "name").limit(8).agg(F.array_join(F.transform(first, lambda x: x["name"]), ", ").alias("names"))
    n = people.agg(F.count("*").alias("n"))
    work = projects.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("work"))
    flags = ambiguous_flags(people).agg(F.array_join(F.sort_array(F.collect_list("word")), ", ").alias("flags"))
    cache = wiki.agg(F.count("*").alias("w"))
    row = names
    for side in (n, work, flags, cache):
        row = row.join(F.broadcast(side))  # one row each
    none = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("(none)")
    text = F.concat_ws(
        "\n",
        F.lit(f"Mode: {mode}"),
        F.concat(F.lit("People: "), F.col("n").cast("string"), F.lit(" ("), "names", F.when(F.col("n") > 8, "...").otherwise(""), F.lit(")")),
        F.concat(F.lit("Projects: "), none("work")),
        F.concat(F.lit("Ambiguous flags: "), none("flags")),
        F.concat(F.lit("Wiki cache: "), F.col("w").cast("string"), F.lit(" entries")),
    )
    return row.select(text.alias("summary"))
