"""Text expressions. All of them are built-in functions, so they stay on the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.functions import rules

# Line ends of str.splitlines, other than a line feed.
LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITE = " \t\n\r\x0b\x0c"


def any_of(text: Column, words: Iterable[str]) -> Column:
    """True when `text` holds at least one of `words`.

    A word that holds another one of the list cannot change the answer and is not searched.
    """
    words = list(dict.fromkeys(words))
    hit = F.lit(False)
    for word in words:
        if not any(other != word and other in word for other in words):
            hit = hit | F.contains(text, F.lit(word))
    return hit


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def find_distinct(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_distinct(find_all(text, pattern, group))


def tally(values: Column) -> Column:
    """array of struct(value, n): distinct elements with how often each occurs.

    Counting inside the row needs no shuffle; sorting first keeps it linear after the sort.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda v, i: F.when((i == 0) | (v != F.get(ordered, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda known: F.transform(
                known,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("value"),
                    (F.coalesce(F.get(known, k + 1), F.size(ordered)) - at).cast("long").alias("n"),
                ),
            ),
        )

    return let(F.array_sort(values), runs)


def guarded(text: Column, needles: Iterable[str], values: Column, kind: str = "array<string>") -> Column:
    """`values`, a list that can only be non-empty when `text` holds one of the needles.

    The plain substring test is many times cheaper than the pattern search it saves.
    """
    return F.when(any_of(text, needles), values).otherwise(F.array().cast(kind))


def with_lower(files: DataFrame) -> DataFrame:
    """Add `_lower`, the lower-cased text, once for all the expressions that look at it."""
    return files if "_lower" in files.columns else files.withColumn("_lower", F.lower("content"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def unix_lines(text: Column) -> Column:
    """Every line end becomes a line feed and one trailing line end is dropped."""
    flat = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), LINE_END, "\n")
    return let(
        flat, lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.char_length(t) - 1)).otherwise(t)
    )


def feed_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """len(text.splitlines())"""
    lines = let(unix_lines(text), lambda flat: feed_count(flat) + 1)
    return F.when(text == "", F.lit(0)).otherwise(lines).cast("long")


def cut(text: Column, n: int | None, side: str = "head", ellipsis: str = "none") -> Column:
    """Cut to n characters, or leave whole without n.

    ellipsis: 'none' = plain cut, 'after' = n characters then '...', 'inside' = '...' counts
    within the n characters.
    """
    if n is None:
        return text
    if side == "tail":
        return F.when(F.char_length(text) > n, F.substring(text, -n, n)).otherwise(text)
    if ellipsis == "after":
        return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
    if ellipsis == "inside":
        return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)
    return F.substring(text, 1, n)


def first_n(values: Column, n: int | None) -> Column:
    """The first n values, or all without n."""
    return values if n is None else F.slice(values, 1, n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[empty_to_null(c) for c in cols])


def with_default(col: Column, default: str) -> Column:
    return F.coalesce(col, F.lit(default))


def extract_yaml(text: Column) -> Column:
    """The first fenced block that looks like a bundle config, stripped; NULL when none."""
    blocks = F.filter(
        find_all(text, rules.YAML_FENCE),
        lambda block: any_of(block, rules.YAML_CLUES),
    )
    return strip(F.get(blocks, 0))


def to_b64(text: Column) -> Column:
    """Base64 on one line, as an upload needs it."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def to_record(names: Column, values: Column) -> Column:
    return F.map_from_arrays(names, values)


def cost_text(cost: Column) -> Column:
    """'$0.0000' form for a non-zero cost, else NULL.

    format_number rounds the exact binary value, where format_string would round its shortest
    decimal spelling; below one unit of the last digit it needs help.
    """
    unit = 0.0001
    tiny = F.when(F.abs(cost) >= unit / 2, "0.0001").otherwise("0.0000")
    sign = F.when(cost < 0, "-").otherwise("")
    usual = F.translate(F.format_number(cost, 4), ",", "")
    return F.when(
        cost != 0, F.concat(F.lit("$"), F.when(F.abs(cost) < unit, F.concat(sign, tiny)).otherwise(usual))
    )


def drop_words(values: Column, words: Iterable[str]) -> Column:
    """Elements whose upper-case form is not in `words`; order and duplicates kept."""
    deny = [word.upper() for word in words]
    return F.filter(values, lambda value: ~F.upper(value).isin(deny))


def known_words(values: Column, words: Iterable[str]) -> Column:
    return F.array_intersect(values, F.array(*[F.lit(word) for word in words]))
