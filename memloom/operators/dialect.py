"""A compact symbolic summary of texts: entities, topics, key sentence, emotions and flags, as columns of one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.lexicon import DECISION_WORDS, EMOTION_CODES, EMOTION_SIGNALS, EMOTIONAL_WORDS, FLAG_SIGNALS, STOP_WORDS
from memloom.functions.text import SPACE, SPACES, basename, col, contained, count_contained, let, round_half_up, trim


def emotions(text: Column | str) -> Column:
    return contained(F.lower(col(text)), EMOTION_SIGNALS)


def flags(text: Column | str) -> Column:
    return contained(F.lower(col(text)), FLAG_SIGNALS)


def topics(text: Column | str, most: int = 3) -> Column:
    """The heaviest words: one for each occurrence, two more where it is capitalised, two more where it is compound."""
    words = F.filter(F.regexp_extract_all(col(text), F.lit("([a-zA-Z][a-zA-Z_-]{2,})"), F.lit(1)), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    weight = lambda w: 1 + F.when(w.rlike("^[A-Z]"), 2).otherwise(0) + F.when(w.rlike("[_-]|.[A-Z]"), 2).otherwise(0)
    weighed = F.array_sort(F.transform(words, lambda w, i: F.struct(F.lower(w).alias("u"), i.alias("i"), weight(w).alias("w"))))  # equal words side by side

    def best_with(s: Column) -> Column:
        """The best words so far and the one just summed up, heaviest first, earlier ones before later ones."""
        grown = F.slice(F.array_sort(F.concat(s["best"], F.array(F.struct((-s["w"]).alias("w"), s["i"].alias("i"), s["u"].alias("u"))))), 1, most)
        return F.when(s["w"] > 0, grown).otherwise(s["best"])

    def add(s: Column, x: Column) -> Column:
        same = s["u"] == x["u"]
        return F.struct(x["u"].alias("u"), F.when(same, s["i"]).otherwise(x["i"]).alias("i"), (x["w"] + F.when(same, s["w"]).otherwise(0)).alias("w"), F.when(same, s["best"]).otherwise(best_with(s)).alias("best"))

    nothing = F.struct(F.lit("").alias("u"), F.lit(0).alias("i"), F.lit(0).alias("w"), F.array().cast("array<struct<w:int,i:int,u:string>>").alias("best"))
    return F.transform(F.aggregate(weighed, nothing, add, best_with), lambda x: x["u"])


def key_sentence(text: Column | str) -> Column:
    """The first of the best sentences, cut to 55 characters; empty if none has more than ten."""
    sentences = F.filter(F.transform(F.split(col(text), r"[.!?\n]+"), lambda s: trim(s)), lambda s: F.length(s) > 10)

    def score(s: Column) -> Column:
        n = F.length(s)
        return 2 * let(F.lower(s), lambda low: count_contained(low, DECISION_WORDS)) + (n < 80).cast("int") + (n < 40).cast("int") - 2 * (n > 150).cast("int")

    ranked = F.array_sort(F.transform(sentences, lambda s, i: F.struct((-score(s)).alias("w"), i.alias("i"), s.alias("s"))))
    cut = lambda best: F.when(F.length(best) > 55, F.concat(F.substring(best, 1, 52), F.lit("..."))).otherwise(best)
    return F.coalesce(let(F.get(ranked, F.lit(0))["s"], cut), F.lit(""))


def entities(text: Column | str, codes: Mapping[str, str] | None = None) -> Column:
    """Codes of the known names that the text contains; if there are none, of up to three capitalised words after the first."""
    body = col(text)
    words = F.slice(F.split(body, f"{SPACE}+"), 2, 1_000_000)
    clean = F.transform(words, lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    names = F.filter(clean, lambda w: w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(*STOP_WORDS))
    guessed = F.slice(F.array_distinct(F.transform(names, lambda w: F.upper(F.substring(w, 1, 3)))), 1, 3)
    known = [(k.lower(), c) for k, c in (codes or {}).items() if k[:1].isascii() and k[:1].isupper()]
    if not known:
        return guessed
    found = contained(F.lower(body), known, most=len(known))
    return F.when(F.size(found) > 0, found).otherwise(guessed)


def compress(text: Column | str, *, source_file: Column | None = None, wing: Column | None = None, room: Column | None = None, date: Column | None = None, codes: Mapping[str, str] | None = None) -> Column:
    """A content line of what the text has, after a header line if a file or wing is given."""
    some = lambda x: F.when(x != "", x)
    body = F.concat_ws(
        "|",
        let(F.array_join(F.slice(entities(text, codes), 1, 3), "+"), lambda x: F.concat(F.lit("0:"), F.coalesce(some(x), F.lit("???")))),
        let(F.array_join(topics(text), "_"), lambda x: F.coalesce(some(x), F.lit("misc"))),
        let(key_sentence(text), lambda x: F.when(x != "", F.concat(F.lit('"'), x, F.lit('"')))),
        let(F.array_join(emotions(text), "+"), some),
        let(F.array_join(flags(text), "+"), some),
    )
    if source_file is None and wing is None:
        return body
    or_mark = lambda x: F.coalesce(x, F.lit("?")) if x is not None else F.lit("?")
    stem = F.regexp_replace(basename(source_file), r"\.[^.]+$", "") if source_file is not None else None
    header = F.concat_ws("|", or_mark(wing), or_mark(room), or_mark(date), or_mark(stem))
    shown = F.lit(False)
    for x in (source_file, wing):
        shown = shown | (x.isNotNull() & (x != "")) if x is not None else shown
    return F.concat(F.when(F.coalesce(shown, F.lit(False)), F.concat(header, F.lit("\n"))).otherwise(F.lit("")), body)


def count_tokens(text: Column | str) -> Column:
    """Words times 1.3, rounded, one at least."""
    words = F.size(F.array_remove(F.split(F.translate(col(text), SPACES, " " * len(SPACES)), " "), ""))  # no regular expression: four times as fast
    return F.greatest(F.lit(1), F.floor(words * 1.3 + 0.5)).cast("long")


def compression_stats(text: Column | str, summary: Column | str) -> Column:
    return let(
        F.struct(count_tokens(text).alias("b"), count_tokens(summary).alias("a")),
        lambda n: F.struct(
            n["b"].alias("original_tokens_est"),
            n["a"].alias("summary_tokens_est"),
            round_half_up(n["b"] / n["a"], 1).alias("size_ratio"),
            F.length(col(text)).cast("long").alias("original_chars"),
            F.length(col(summary)).cast("long").alias("summary_chars"),
        ),
    )


def decode(summary: Column | str) -> Column:
    """The lines of a summary by kind: header fields (the last header wins), arc, zettels and tunnels."""
    first = lambda x: F.get(F.split(x, r"\|"), F.lit(0))
    kind = lambda x: F.when(x.startswith("ARC:"), "arc").when(x.startswith("T:"), "tunnel").when(F.contains(x, F.lit("|")), F.when(F.contains(first(x), F.lit(":")), "zettel").otherwise("header"))
    marked = F.transform(F.split(trim(summary), "\n"), lambda x: F.struct(kind(x).alias("k"), x.alias("x")))

    def parts(lines: Column) -> Column:
        of = lambda k: F.transform(F.filter(lines, lambda m: m["k"] == k), lambda m: m["x"])
        header = F.split(F.try_element_at(of("header"), F.lit(-1)), r"\|")
        field = lambda h, i: F.when(h.isNotNull(), F.coalesce(F.get(h, F.lit(i)), F.lit("")))
        fields = let(header, lambda h: F.struct(*(field(h, i).alias(n) for i, n in enumerate(("file", "entities", "date", "title")))))
        return F.struct(fields.alias("h"), F.coalesce(F.substring(F.try_element_at(of("arc"), F.lit(-1)), 5, 1_000_000), F.lit("")).alias("arc"), of("zettel").alias("zettels"), of("tunnel").alias("tunnels"))

    return let(let(marked, parts), lambda p: F.struct(*(p["h"][n].alias(n) for n in ("file", "entities", "date", "title")), p["arc"].alias("arc"), p["zettels"].alias("zettels"), p["tunnels"].alias("tunnels")))


# ── Zettels: structured notes ────────────────────────────────────────────────


def encode_entity(name: Column, codes: Mapping[str, str] | None = None, skip: Sequence[str] = ()) -> Column:
    """A name's code: null if it is skipped, else the exact, the lower-case or a contained name's, else its first three letters."""
    lower, out = F.lower(name), F.upper(F.substring(name, 1, 3))
    for k, c in reversed((codes or {}).items()):
        out = F.when(F.contains(lower, F.lit(k.lower())), F.lit(c)).otherwise(out)
    for k, c in reversed((codes or {}).items()):
        out = F.when((name == k) | (lower == k.lower()), F.lit(c)).otherwise(out)
    for s in skip:
        out = F.when(F.contains(lower, F.lit(s.lower())), F.lit(None).cast("string")).otherwise(out)
    return out


def encode_emotions(names: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EMOTION_CODES.items() for x in kv))
    codes = F.transform(names, lambda e: F.coalesce(F.try_element_at(table, e), F.substring(e, 1, 4)))
    return F.array_join(F.slice(F.array_distinct(codes), 1, 3), "+")


def zettel_flags(z: Column) -> Column:
    notes, origin = F.lower(F.coalesce(z["notes"], F.lit(""))), F.lower(F.coalesce(z["origin_label"], F.lit("")))
    has = lambda x, w: F.contains(x, F.lit(w))
    return F.concat_ws(
        "+",
        F.when(F.coalesce(z["origin_moment"], F.lit(False)), "ORIGIN"),
        F.when(F.upper(z["sensitivity"]).startswith("MAXIMUM"), "SENSITIVE"),
        F.when(has(notes, "foundational pillar") | has(notes, "core"), "CORE"),
        F.when(has(notes, "genesis") | has(origin, "genesis"), "GENESIS"),
        F.when(has(notes, "pivot"), "PIVOT"),
    )


def key_quote(z: Column) -> Column:
    """The most telling quotation in a zettel, else what follows the dash in its title."""
    empty = lambda c: F.coalesce(z[c], F.lit(""))
    text = F.concat_ws(" ", empty("content"), empty("origin_label"), empty("notes"))
    found = F.concat(
        F.regexp_extract_all(text, F.lit('"([^"]{8,55})"'), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(?:^|[\s(])'([^']{8,55})'(?:[\s.,;:!?)]|$)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit("(?i)(?:says?|said|articulates?|reveals?|admits?|confesses?|asks?):\\s*[\"']?([^.!?]{10,55})[.!?]"), F.lit(1)),
    )
    quotes = F.array_distinct(F.filter(F.transform(found, lambda q: trim(q)), lambda q: F.length(q) >= 8))

    def score(q: Column) -> Column:
        first = F.substring(q, 1, 1)
        out = 2 * (F.upper(first) == first).cast("int") + 2 * count_contained(F.lower(q), EMOTIONAL_WORDS) + (F.length(q) > 20).cast("int")
        return out - 2 * (q.startswith("The ") | q.startswith("This ") | q.startswith("She ")).cast("int")

    ranked = F.array_sort(F.transform(quotes, lambda q, i: F.struct((-score(q)).alias("w"), i.alias("i"), q.alias("q"))))  # few quotes
    title = F.get(F.split(empty("title"), " - "), F.lit(1))
    return F.coalesce(F.get(ranked, F.lit(0))["q"], F.substring(title, 1, 45), F.lit(""))


def _last_part(x: Column) -> Column:
    return F.element_at(F.split(F.coalesce(x, F.lit("")), "-"), -1)


def encode_zettel(z: Column, codes: Mapping[str, str] | None = None, skip: Sequence[str] = ()) -> Column:
    """One line for a zettel: id, people, topics, quotation, weight, emotions, flags."""
    people = F.filter(F.transform(F.coalesce(z["people"], F.array().cast("array<string>")), lambda p: encode_entity(p, codes, skip)), lambda c: c.isNotNull())
    who = F.when(F.size(people) > 0, F.array_join(F.array_sort(F.array_distinct(people)), "+")).otherwise(F.lit("???"))
    about = F.coalesce(z["topics"], F.array().cast("array<string>"))
    quote, feel, mark = key_quote(z), encode_emotions(F.coalesce(z["emotional_tone"], F.array().cast("array<string>"))), zettel_flags(z)
    weight = F.regexp_replace(F.coalesce(z["emotional_weight"], F.lit(0.5)).cast("string"), r"\.0$", "")
    return F.concat_ws(
        "|",
        F.concat(_last_part(z["id"]), F.lit(":"), who),
        F.when(F.size(about) > 0, F.array_join(F.slice(about, 1, 2), "_")).otherwise(F.lit("misc")),
        F.when(quote != "", F.concat(F.lit('"'), quote, F.lit('"'))),
        weight,
        F.when(feel != "", feel),
        F.when(mark != "", mark),
    )


def encode_tunnel(t: Column) -> Column:
    label = F.coalesce(t["label"], F.lit(""))
    short = F.when(F.contains(label, F.lit(":")), F.get(F.split(label, ":"), F.lit(0))).otherwise(F.substring(label, 1, 30))
    return F.concat(F.lit("T:"), _last_part(t["from"]), F.lit("<->"), _last_part(t["to"]), F.lit("|"), short)


def encode_file(f: Column, codes: Mapping[str, str] | None = None, skip: Sequence[str] = ()) -> Column:
    """A file (source_file, zettels, tunnels, emotional_arc) as a header, its arc and a line for each zettel and tunnel."""
    source = F.coalesce(f["source_file"], F.lit("unknown"))
    dashed = F.contains(source, F.lit("-"))
    people = F.array_distinct(F.flatten(F.transform(f["zettels"], lambda z: F.filter(F.transform(F.coalesce(z["people"], F.array().cast("array<string>")), lambda p: encode_entity(p, codes, skip)), lambda c: c.isNotNull()))))
    primary = F.when(F.size(people) > 0, F.array_join(F.slice(F.array_sort(people), 1, 3), "+")).otherwise(F.lit("???"))
    number = F.when(dashed, F.get(F.split(source, "-"), F.lit(0))).otherwise(F.lit("000"))
    title = F.when(dashed, trim(F.array_join(F.slice(F.split(F.regexp_replace(source, r"^(.*?)\.txt", "$1"), "-"), 2, 1_000_000), "-"))).otherwise(source)
    date = F.coalesce(F.get(f["zettels"], F.lit(0))["date_context"], F.lit("unknown"))
    arc = F.coalesce(f["emotional_arc"], F.lit(""))
    lines = F.concat(
        F.array(F.concat_ws("|", number, primary, date, title)),
        F.when(arc != "", F.array(F.concat(F.lit("ARC:"), arc))).otherwise(F.array().cast("array<string>")),
        F.transform(f["zettels"], lambda z: encode_zettel(z, codes, skip)),
        F.transform(f["tunnels"], encode_tunnel),
    )
    return F.array_join(lines, "\n")


#: What a reader of summaries needs to know.
SPECIFICATION = """Header: wing|room|date|file. Line: number:PEOPLE|topics|"key sentence"|emotions|FLAGS.
People are three capital letters, joined by +; topics are joined by _. Parts that are missing are left out.
ARC: the emotional arc. T: a link between two notes."""
