"""Finding people and projects in prose: candidates, signals and their classification."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.lexicon import CODE_PATTERN, DIALOGUE_PATTERNS, DIRECT_PATTERN, NO_NAMES, PERSON_VERBS, PRONOUNS, PROJECT_VERBS, STOP_WORDS, VERSIONED_PATTERN
from memloom.functions.text import LEFT, RIGHT, once, round_half_up

#: Signals of an entity that count, of each kind.
KEPT_SIGNALS = 3


#: Stands for the name in a text; a word character to the patterns below.
MARK = "\ue000"
_WORD = f"A-Za-z0-9_{MARK}"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b and \w that only know ASCII word characters and MARK."""
    edge = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
    for near, simple in ((rf"\b{MARK}", f"{MARK}(?<![{_WORD}]{MARK})"), (rf"{MARK}\b", f"{MARK}(?![{_WORD}])")):
        pattern = pattern.replace(near, simple)  # the mark first, as few places have it
    pattern = re.sub(r"\\b(?=[a-z])", f"(?<![{_WORD}])", pattern)
    return re.sub(r"(?<=[a-z])\\b", f"(?![{_WORD}])", pattern).replace(r"\b", edge).replace(r"\w", f"[{_WORD}]")


def for_mark(pattern: str, options: str = "") -> str:
    """The pattern with MARK in place of {}: a constant, compiled once for all names and texts."""
    return (f"(?{options})" if options else "") + ascii_bounds(pattern.replace("{}", MARK))


def needed_word(pattern: str) -> str:
    """The longest word that every match has, or the mark: texts without it aren't searched."""
    if re.search(r"\|(?![^()]*\))", pattern):  # alternatives outside groups
        return MARK
    plain = re.sub(r"\\[bswd][+*]?", " ", re.sub(r"\([^()]*\)\??", " ", pattern))
    words = [w[:-2] if w.endswith("?") else w for w in re.findall(r"[a-z]+\??", plain)]
    return max((w for w in words if len(w) > 1), key=len, default=MARK)


def marked(text: Column, name: Column) -> Column:
    """The text in lower case, with MARK for the name whatever its case. Patterns ignore case, so nothing else is lost."""
    return F.replace(F.lower(text), F.lower(name), F.lit(MARK))


def candidates(texts: DataFrame, key: str, *, stop_words: Sequence[str] | None = None, least: int = 3) -> DataFrame:
    """texts (key, text) -> (key, name, frequency): capitalised words and runs of them, at least so often.

    stop_words: all words, in lower case, that are no name; without it the built-in lists hold.
    """
    stop = F.array(F.lit(""), *(F.lit(w) for w in dict.fromkeys([*STOP_WORDS, *NO_NAMES] if stop_words is None else stop_words)))
    single = F.regexp_extract_all("text", F.lit(f"{LEFT}([A-Z][a-z]{{1,19}}){RIGHT}"), F.lit(1))
    several = F.regexp_extract_all("text", F.lit(rf"{LEFT}([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+){RIGHT}"), F.lit(1))
    no_stop = lambda phrase: ~F.exists(F.split(F.lower(phrase), r"\s+"), lambda w: F.array_contains(stop, w))
    found = F.filter(F.concat(single, several), no_stop)
    return texts.select(key, F.explode(found).alias("name")).groupBy(key, "name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def score(names: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """names (key, name, frequency), texts (key, text: all of a key's) -> their scores and signals.

    Each kind of signal adds its weight for every match. The pronoun signal counts lines with
    the name that have a pronoun within two lines. Of each side only the first signals stay.
    """
    met = names.join(texts.hint("merge"), key)  # dealt by the texts' size: with either side broadcast, few tasks would search all texts
    count = lambda p, o="": F.when(F.contains(F.col("marked"), F.lit(needed_word(p))), F.regexp_count("marked", F.lit(for_mark(p, o)))).otherwise(0)
    pronoun = ascii_bounds(rf"\b(?:{'|'.join(PRONOUNS)})\b")
    lines = F.transform(F.split(F.lower("text"), "\n", -1), lambda x: F.struct(F.contains(x, F.lower("name")).alias("named"), x.rlike(pronoun).alias("pronoun")))
    met = once(met, {"lines": lines, "marked": marked(F.col("text"), F.col("name"))})
    near = lambda i: F.exists(F.slice("lines", F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3)) + 2), lambda x: x["pronoun"])
    hits = F.filter(F.transform("lines", lambda x, i: x["named"] & near(i)), lambda x: x)

    action = F.concat(F.lit("'"), F.col("name"), F.lit(" ...' action"))
    direct = sum((count(p) for p in DIRECT_PATTERN.split("|")), F.lit(0))  # each ends with the name, before which there is one word only
    person = [(3, count(p, "m"), F.lit("dialogue marker")) for p in DIALOGUE_PATTERNS]
    person += [(2, count(p), action) for p in PERSON_VERBS]
    person += [(2, F.size(hits), F.lit("pronoun nearby")), (4, direct, F.lit("addressed directly"))]
    project = [(2, count(p), F.lit("project verb")) for p in PROJECT_VERBS]
    project += [(3, count(VERSIONED_PATTERN), F.lit("versioned/hyphenated")), (3, count(CODE_PATTERN), F.lit("code file reference"))]
    counted = once(met, {c: F.array(*(n for _, n, _ in side)) for c, side in (("_p", person), ("_q", project))})  # before they are named, else each is searched for twice

    def signals(c: str, side: list[tuple[int, Column, Column]]) -> Column:
        n = lambda i: F.get(c, F.lit(i))
        return F.array(*(F.struct(n(i).alias("n"), F.concat(text, F.lit(" ("), n(i).cast("string"), F.lit("x)")).alias("s")) for i, (_, _, text) in enumerate(side)))

    out = once(counted, {"p": signals("_p", person), "q": signals("_q", project)})

    def total(c: str, weights: list[int]) -> Column:
        each = F.zip_with(c, F.array(*map(F.lit, weights)), lambda x, w: x["n"] * w)
        return F.aggregate(each, F.lit(0), lambda s, x: s + x)

    first = lambda c: F.slice(F.transform(F.filter(c, lambda x: x["n"] > 0), lambda x: x["s"]), 1, KEPT_SIGNALS)
    scores = {"person_score": total("p", [w for w, _, _ in person]), "project_score": total("q", [w for w, _, _ in project]), "person_signals": first("p"), "project_signals": first("q")}
    return once(out.select(key, "name", "frequency", "p", "q"), scores).drop("p", "q")


def classify(scored: DataFrame) -> DataFrame:
    """Adds type (person, project or uncertain), confidence and signals."""
    ps, prs = F.col("person_score"), F.col("project_score")
    ratio = ps / (ps + prs)
    has = lambda word: F.exists("person_signals", lambda s: F.contains(s, F.lit(word))).cast("int")
    kinds = has("dialogue") + has("action") + has("pronoun") + has("addressed")
    appears = F.concat(F.lit("appears "), F.col("frequency").cast("string"), F.lit("x"))
    nothing, person, project = (ps + prs) == 0, (ratio >= 0.7) & (kinds >= 2) & (ps >= 5), ratio <= 0.3
    kind = F.when(nothing, "uncertain").when(person, "person").when(ratio >= 0.7, "uncertain").when(project, "project").otherwise("uncertain")
    sure = (
        F.when(nothing, F.least(F.lit(0.4), F.col("frequency") / 50))
        .when(person, F.least(F.lit(0.99), 0.5 + ratio * 0.5))
        .when(ratio >= 0.7, F.lit(0.4))
        .when(project, F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5))
        .otherwise(F.lit(0.5))
    )
    or_appears = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(appears))
    signals = (
        F.when(nothing, F.array(F.concat(appears, F.lit(", no strong type signals"))))
        .when(person, or_appears("person_signals"))
        .when(ratio >= 0.7, F.concat(F.col("person_signals"), F.array(F.concat(appears, F.lit(" — pronoun-only match")))))
        .when(project, or_appears("project_signals"))
        .otherwise(F.concat(F.slice(F.concat("person_signals", "project_signals"), 1, 3), F.array(F.lit("mixed signals — needs review"))))
    )
    return once(scored, {"type": kind, "confidence": round_half_up(sure, 2), "signals": signals})


def combined(texts: DataFrame, key: str, order: str, *, max_texts: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(key, text): the texts of each key, or its first ones, each cut if asked, one after the other on lines of their own."""
    some = texts.select(key, F.col(order).alias("_n"), F.col("text") if max_chars is None else F.substring("text", 1, max_chars).alias("text"))
    if max_texts is not None:
        some = some.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("_n"))).where(F.col("_at") <= max_texts)
    lines = F.array_sort(F.collect_list(F.struct("_n", "text")))
    return some.groupBy(key).agg(lines.alias("x")).select(key, F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("text"))


def detect(texts: DataFrame, key: str, order: str, *, max_texts: int = 10, max_chars: int = 5000, stop_words: Sequence[str] | None = None) -> DataFrame:
    """texts (key, order, text) -> the entities of each key's first texts, ranked within their type and cut to 15, 10 and 8."""
    whole = combined(texts, key, order, max_texts=max_texts, max_chars=max_chars)
    found = classify(score(candidates(whole, key, stop_words=stop_words), whole, key))
    by = F.when(F.col("type") == "uncertain", F.col("frequency").cast("double")).otherwise(F.col("confidence"))
    rank = F.row_number().over(Window.partitionBy(key, "type").orderBy(by.desc(), F.desc("frequency"), "name"))
    most = F.when(F.col("type") == "person", 15).when(F.col("type") == "project", 10).otherwise(8)
    return found.withColumn("rank", rank).where(F.col("rank") <= most)
