"""Spans as Columns: all offsets count code points, from 0, ends excluded; everything runs inside Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
SPANS = f"array<{SPAN}>"
MATCH = "struct<entity_type:string,start:int,end:int,text:string,confidence:double,tier:string,source:string,context:string,det_ord:int,approved:boolean>"
MATCHES = f"array<{MATCH}>"

def reused(build: Callable[..., Column]) -> Callable[..., Column]:
    """Columns are immutable: those for the same arguments are built once a JVM, as each call over its gateway takes time."""
    kept = lru_cache(256)(lambda gateway, *args: build(*args))
    return wraps(build)(lambda *args: kept(id(SparkContext._gateway), *args))


def none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def span(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))


def spans_of(text: Column, pattern: str, fold_case: bool = True, needs: str | Column | None = None) -> Column:
    """All matches of a pattern that matches no empty text, left to right; an empty array if there is none or no text.

    needs: a cheap pattern that every text with a match has, or a condition that it meets, looked at first."""
    p = F.lit(("(?iU)" if fold_case else "(?U)") + pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, p, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(acc, x):
        a = acc["at"] + x["g"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(span(a, b, x["m"]))).alias("out"))

    some = text.rlike(("(?iU)" if fold_case else "(?U)") + pattern)
    if needs is not None:
        some = F.when(text.rlike(needs) if isinstance(needs, str) else needs, some)
    return F.when(some, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none())


def anchored(text: Column, start: Column, pattern: str, fold_case: bool = True) -> Column:
    """What the pattern matches right at `start`, or an empty text."""
    return F.regexp_extract(F.substring(text, start + 1, F.length(text)), ("(?iU)^(?:" if fold_case else "(?U)^(?:") + pattern + ")", 0)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def before(text: Column, start: Column, n: int) -> Column:
    """Up to n characters before start."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def overlaps(a_start: Column, a_end: Column, b: Column) -> Column:
    return (a_start < b["end"]) & (b["start"] < a_end)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def snippet(text: Column, start: Column, end: Column, window: int = 40) -> Column:
    """The span in brackets with up to `window` characters around it; dots where that cuts."""
    left = F.concat(F.when(start > window, "...").otherwise(""), before(text, start, window))
    right = F.concat(F.substring(text, end + 1, F.lit(window)), F.when(end + window < F.length(text), "...").otherwise(""))
    return strip(F.concat(left, F.lit("["), F.substring(text, start + 1, end - start), F.lit("]"), right))


def luhn(digits: Column, least: int = 13, most: int | None = None) -> Column:
    """Whether the last digit is right by the mod-10 rule."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: F.try_to_number(x, F.lit("9")).cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    ok = (F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0) & (F.length(digits) >= least)
    return F.coalesce(ok if most is None else ok & (F.length(digits) <= most), F.lit(False))


def luhn_generate(prefix: str, length: int) -> str:
    """The prefix, filled with (3 * position + 7) % 10, and its check digit."""
    body = prefix + "".join(str((i * 3 + 7) % 10) for i in range(len(prefix), length - 1))
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def hash_text(x: Column) -> Column:
    return F.substring(F.sha2(strip(x).cast("binary"), 256), 1, 16)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def match_rows(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """A row for each of `matches`, with the columns to keep.

    Outer, so that Spark infers no filter on the array and pushes none below the detectors: that would detect twice."""
    return rows.select(*keep, F.inline_outer("matches")).where("entity_type is not null")


def valid_spans(text: Column, spans: Column) -> Column:
    """The spans within the text that hold what they say."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] <= s["end"]) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["text"]))


def splice(text: Column, matches: Column) -> Column:
    """The text with each span replaced (a null replacement deletes); the spans must be disjoint."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.coalesce(m["replacement"], F.lit("")).alias("r"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, lambda acc, m: F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), m["r"]).alias("out")), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(matches) > 0, done).otherwise(text)
