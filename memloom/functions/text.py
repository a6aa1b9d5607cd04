"""Column expressions for text that follow ECMAScript's rules where Spark's built-ins differ."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space as ECMAScript's trim() and \s know it.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = f"[{SPACES}]"
#: Word boundaries that only know ASCII word characters.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also inside lambdas, where Spark shares no subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with further columns that are computed once a row: no filter or projection above is merged into them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def trim(x: Column | str) -> Column:
    return F.trim(col(x), F.lit(SPACES))


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def snippet(x: Column | str, most: int) -> Column:
    """Trimmed, on one line, and cut to most characters with an ellipsis."""
    line = F.regexp_replace(trim(x), "\n", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def token_estimate(x: Column | str) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(col(x)) / 4).cast("long")


def contained(text: Column, pairs: Sequence[tuple[str, str]], most: int = 3) -> Column:
    """The distinct codes of the keywords (keyword, code) that the text contains, in order, at most so many."""
    found = F.array(*(F.when(F.contains(text, F.lit(k)), F.lit(c)) for k, c in pairs))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), 1, most)


def count_contained(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def md5_prefix(x: Column, n: int) -> Column:
    return F.substring(F.md5(x), 1, n)


def iso_utc(epoch: Column) -> Column:
    """Epoch seconds as ISO-8601 text with milliseconds, session time zone UTC."""
    return F.date_format(F.timestamp_micros((epoch * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_of(iso: Column) -> Column:
    """ISO-8601 text as epoch seconds; text that is no time raises in ANSI mode."""
    return F.unix_micros(F.to_timestamp(iso)) / 1e6
