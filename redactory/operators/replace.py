"""Replacements as pure functions of (type, text, seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions import vocabulary as V
from redactory.functions.text import match_rows, reused, strip
from redactory.sources.shared import kept

STRATEGIES = ("SYNTHETIC", "MASK", "TOKEN", "CATEGORY_LABEL")


def seed_int(text: Column, seed: int = 42) -> Column:
    """The first eight hex digits of sha256("seed:text"), as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.lower(strip(text))).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def _pick(words: str, k: Column) -> Column:
    items = words.split()
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(k, F.lit(len(items))) + 1).cast("int"))


def _n(x: Column) -> Column:
    return x.cast("string")


def synthetic(kind: Column, text: Column, seed: int = 42) -> Column:
    k = seed_int(text, seed)
    shifted = F.shiftright(k, 4)
    name = F.concat_ws(" ", _pick(V.FIRST_NAMES, k), _pick(V.LAST_NAMES, shifted))
    local = F.concat(_n(90000 + k % 9999), F.lit(" "), _n(10000 + shifted % 89999))
    form = F.when(text.contains("Private Limited") | text.contains("Pvt. Ltd."), " Private Limited").when(text.contains("LLP"), " LLP").otherwise(" Limited")
    made = {
        "PERSON": F.when((F.upper(text) == text) & (F.lower(text) != text), F.upper(name)).otherwise(name),
        "EMAIL": F.concat(F.lower(_pick(V.FIRST_NAMES, k)), _n(k % 1000), F.lit("@example.com")),
        "PHONE": F.when(text.startswith("+91"), F.concat(F.lit("+91 "), local)).when(text.startswith("+"), F.concat(F.lit("+1-555-"), _n(100 + k % 899), F.lit("-"), _n(1000 + k % 8999))).otherwise(local),
        "COMPANY": F.concat(_pick(V.FIRMS, k), F.lit(" "), _pick(V.LAST_NAMES, shifted), form),
        "ADDRESS": F.concat(F.lit("Plot "), _n(10 + k % 890), F.lit(", "), _pick(V.STREETS, k), F.lit(" Industrial Area, Sector "), _n((10 + k % 890) % 20 + 1), F.lit(", Pune 411001, Maharashtra, India")),
        "DOB": F.format_string("%02d/%02d/%d", 1 + k % 28, 1 + k % 12, 1970 + k % 30),
        "SSN": F.concat(F.lit("9"), _n(k % 89 + 10), F.lit("-"), _n(k % 89 + 10), F.lit("-"), _n(k % 8999 + 1000)),
        "CREDIT_CARD": F.lit("4111 1111 1111 1111"),
        "IP_ADDRESS": F.concat(F.lit("192.168."), _n(k % 250 + 1), F.lit("."), _n(k % 250 + 1)),
        "PAN": F.concat(F.lit("AAAP"), F.substring(F.lit("ABCDE"), (k % 5 + 1).cast("int"), F.lit(1)), _n(k % 8999 + 1000), F.lit("Z")),
        "UPI_ID": F.concat(F.lit("user"), _n(k % 999), F.lit("@okaxis")),
        "IBAN": F.concat(F.lit("GB29NWBK601613"), _n(k % 89999999 + 10000000)),
    }
    out = F.concat(F.lit("SYNTHETIC_"), kind, F.lit("_"), _n(k % 9999))
    for name_, value in made.items():
        out = F.when(kind == name_, value).otherwise(out)
    return out


def mask(kind: Column, text: Column) -> Column:
    local = F.split_part(text, F.lit("@"), F.lit(1))
    domain = F.substring(text, F.length(local) + 2, F.length(text))
    digits = F.regexp_replace(text, r"(?U)\D", "")
    words = F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), lambda w: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1))).otherwise("*"))
    return (
        F.when((kind == "EMAIL") & text.contains("@"), F.concat(F.when(F.length(local) > 1, F.concat(F.substring(local, 1, 1), F.lit("***"))).otherwise("*"), F.lit("@"), domain))
        .when(kind == "PHONE", F.when(text.startswith("+91"), "+91 XXXXX XXXXX").otherwise("XXX-XXX-XXXX"))
        .when(kind == "CREDIT_CARD", F.concat(F.lit("**** **** **** "), F.when(F.length(digits) >= 4, F.substring(digits, -4, 4)).otherwise("XXXX")))
        .otherwise(F.array_join(words, " "))
    )


def label(kind: Column) -> Column:
    return F.concat(F.lit("[REDACTED "), kind, F.lit("]"))


def token(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), F.format_string("%03d", number), F.lit(">"))


def replacement(kind: Column, text: Column, strategy: str = "SYNTHETIC", seed: int = 42) -> Column:
    """By strategy; an unknown one is synthetic. TOKEN needs numbers, see `numbered`."""
    return mask(kind, text) if strategy == "MASK" else label(kind) if strategy == "CATEGORY_LABEL" else synthetic(kind, text, seed)


def _bounds(rows: DataFrame, at: Column, ranges: int) -> list:
    """Values of `at` that cut the rows into about equal ranges: from those 20 a range with the least hashes, a bounded sample that is the same in every run."""
    some = [r[0] for r in rows.select(at.alias("at")).distinct().orderBy(F.xxhash64("at"), "at").limit(20 * ranges).orderBy("at").collect()]
    return [some[i * len(some) // ranges] for i in range(1, ranges)] if some else []


def _range(at: Column, bounds: list, names: list[str], kinds: list[str]) -> Column:
    """How many bounds are not above `at`, by bisection."""
    told = F.array(*[F.struct(*[F.lit(x).cast(k).alias(n) for x, n, k in zip(b, names, kinds)]) for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, step: F.when(F.coalesce(F.try_element_at(told, lo + step) <= at, F.lit(False)), lo + step).otherwise(lo))


def numbered(matches: DataFrame, doc: str | None = "doc_id", rows_a_range: int = 100_000, most_ranges: int = 1000) -> DataFrame:
    """matches (doc_id, seg_ord, entity_type, start, end, ...) with TOKEN replacements: every occurrence counts up, by type within each document, or
    with doc=None by type across all documents.

    In two passes: the matches are cut into ranges of their order (document, segment, start, end), counted by range, and the
    sums of the ranges before are added to the ranks within each range; so no document and no type is one task's work.
    The matches are written to the shared folder first."""
    order = [c for c in ("doc_id", "seg_ord", "start", "end") if c in matches.columns]
    matches = kept(matches, "matches")
    by = ([doc] if doc else []) + ["entity_type"]
    local = Window.partitionBy(*by, "_range").orderBy(*order)
    ranges = min(most_ranges, matches.count() // rows_a_range + 1)
    at = F.struct(*order)
    kinds = dict(matches.dtypes)
    bounds = _bounds(matches, at, ranges)
    cut = matches.withColumn("_range", _range(at, bounds, order, [kinds[c] for c in order]) if bounds else F.lit(0))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = cut.withColumn("_rank", F.row_number().over(local))
    same = [ranked[c].eqNullSafe(sums[c]) for c in [*by, "_range"]]
    out = ranked.join(sums, same[0] if len(same) == 1 else same, "left").select(*[ranked[c] for c in ranked.columns], "_before")
    return out.withColumn("replacement", token(F.col("entity_type"), F.col("_before") + F.col("_rank"))).drop("_range", "_rank", "_before")


@reused
def _replaced(strategy: str, seed: int) -> Column:
    return F.transform("matches", lambda m: m.withField("replacement", replacement(m["entity_type"], m["text"], strategy, seed)))


def with_replacements(rows: DataFrame, strategy: str = "SYNTHETIC", seed: int = 42) -> DataFrame:
    """rows with `matches` whose structs have a replacement (not for TOKEN)."""
    return rows.withColumn("matches", _replaced(strategy, seed))


def replacement_map(matches: DataFrame, seed: int = 42) -> DataFrame:
    """(entity_type, norm_text, replacement), once each: also the set of known synthetic values.

    Texts that differ in case or in the blanks around them are one value; its replacement is that of the first of them, by document, segment
    and start (as far as the matches have these; else by text)."""
    order = [c for c in ("doc_id", "seg_ord", "start") if c in matches.columns]
    first = matches.groupBy("entity_type", F.lower(strip(F.col("text"))).alias("norm_text")).agg(F.min_by("text", F.struct(*order, "text")).alias("first"))
    return first.select("entity_type", "norm_text", synthetic(F.col("entity_type"), F.col("first"), seed).alias("replacement"))


def first_seen(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows (doc_id, segment_id, seg_ord, text, matches) whose synthetic replacements are those of each value's first occurrence in all rows.

    Only values of which two occurrences would get different replacements (another case or form) are looked up; the others keep
    what their own text gives, so frequent values that are always written alike don't move."""
    flat = kept(match_rows(rows, "doc_id", "segment_id", "seg_ord").select("doc_id", "segment_id", "seg_ord", "entity_type", "start", "end", "text", "replacement"), "replacements")
    norm = F.lower(strip(F.col("text"))).alias("norm_text")
    varied = flat.groupBy("entity_type", norm).agg(F.min_by("text", F.struct("doc_id", "seg_ord", "start", "text")).alias("first"), F.min("replacement").alias("a"), F.max("replacement").alias("b")).where("a <> b")
    new = varied.select("entity_type", "norm_text", synthetic(F.col("entity_type"), F.col("first"), seed).alias("new"))
    changed = flat.withColumn("norm_text", norm).join(new, ["entity_type", "norm_text"]).where("new <> replacement")
    by = changed.groupBy("doc_id", "segment_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "start", "end", "entity_type"), "new"))).alias("_new"))
    put = F.transform("matches", lambda m: m.withField("replacement", F.coalesce(F.try_element_at("_new", F.concat_ws("|", m["start"], m["end"], m["entity_type"])), m["replacement"])))
    return rows.join(by, ["doc_id", "segment_id"], "left").withColumn("matches", F.when(F.col("_new").isNull(), F.col("matches")).otherwise(put)).drop("_new")
