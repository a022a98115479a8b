"""Review, integrity, evaluation, residual scan and reports, as DataFrames."""

from __future__ import annotations

import difflib
import os
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from redactory.functions.text import hash_text, match_rows, splice, strip
from redactory.operators.replace import synthetic
from redactory.operators.substrings import holding, lying, segment_windows, text_windows
from redactory.sources.shared import apart, kept

SCORED_TYPES = "PERSON EMAIL PHONE COMPANY ADDRESS SSN CREDIT_CARD DOB IP_ADDRESS".split()


def match_id(rows: DataFrame) -> DataFrame:
    """Matches with a stable id."""
    return rows.withColumn("match_id", F.sha2(F.concat_ws("|", "doc_id", "segment_id", "start", "end", "entity_type"), 256))


def explode_matches(rows: DataFrame) -> DataFrame:
    return match_rows(rows, "doc_id", "segment_id", "seg_ord")


def last_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each match."""
    return reviews.groupBy("match_id").agg(F.max_by(F.struct("action", "edited_text", "edited_entity_type", "replacement_override"), "review_ord").alias("r")).select("match_id", "r.*")


def apply_reviews(matches: DataFrame, reviews: DataFrame, seed: int = 42) -> DataFrame:
    """APPROVE, REJECT, EDIT, CHANGE_TYPE; unknown ids count for nothing; a changed type gets a new replacement."""
    m = matches.withColumn("user_edited", F.lit(False)) if "user_edited" not in matches.columns else matches
    rows = m.join(last_reviews(reviews), "match_id", "left")
    edit, change = F.coalesce(F.col("action") == "EDIT", F.lit(False)), F.coalesce(F.col("action") == "CHANGE_TYPE", F.lit(False))
    kind = F.when(change, F.coalesce("edited_entity_type", "entity_type")).otherwise(F.col("entity_type"))
    out = {
        "text": F.when(edit, F.coalesce("edited_text", "text")).otherwise(F.col("text")),
        "entity_type": kind,
        "approved": F.when(F.col("action") == "REJECT", False).when(F.col("action").isNotNull(), True).otherwise(F.col("approved")),
        "user_edited": F.col("user_edited") | edit | change,
        "replacement": F.when(edit | change, F.coalesce("replacement_override", F.when(change, synthetic(kind, F.col("text"), seed)), "replacement")).otherwise(F.col("replacement")),
    }
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in m.columns])


def integrity_rows(original: DataFrame, redacted: DataFrame) -> DataFrame:
    """original: doc_id, segment_id, text, matches (approved ones, with replacements); redacted: doc_id, segment_id, text.

    Segments on one side only fail as well."""
    order = ["seg_ord"] if "seg_ord" in original.columns else []
    left = original.select("doc_id", "segment_id", *order, F.col("text").alias("original"), splice(F.col("text"), F.col("matches")).alias("expected"), F.size("matches").alias("n_spans"))
    both = left.join(redacted.select("doc_id", "segment_id", F.col("text").alias("actual")), ["doc_id", "segment_id"], "full")
    return both.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


#: Texts up to the first length are compared whole. Of longer ones what they begin and end with alike is left out, which may mark another one of
#: equal neighbours; of middles beyond the second length all counts as changed: a diff takes more than linear time.
PLAIN_DIFF, LONGEST_DIFF = 1000, 5000


def _middles(a: str, b: str) -> tuple[str, str, str, str]:
    """What two texts begin with alike, the middle of each, and what both end with; of short texts all is middle."""
    if max(len(a), len(b)) <= PLAIN_DIFF:
        return "", a, b, ""
    first = len(os.path.commonprefix([a, b]))
    a_, b_ = a[first:], b[first:]
    last = len(os.path.commonprefix([a_[::-1], b_[::-1]]))
    return a[:first], a_[: len(a_) - last], b_[: len(b_) - last], a_[len(a_) - last :]


def _ndiff(a: str, b: str) -> Iterator[str]:
    """difflib.ndiff, whose matcher is slow; if one text begins with the other, the longest match is always all of the shorter one, from its start on."""
    if not (a.startswith(b) or b.startswith(a)):
        return difflib.ndiff(a, b)
    n = min(len(a), len(b))
    return chain((f"  {x}" for x in a[:n]), (f"- {x}" for x in a[n:]), (f"+ {x}" for x in b[n:]))


def diff_of(expected: str, actual: str, most: int | None = None) -> list[str]:
    """A line diff of single characters; most: so many entries are enough."""
    same, a, b, end = _middles(expected or "", actual or "")
    out = [f"  {x}" for x in same[:most]]
    if most is None or len(out) < most:
        short = len(a) <= LONGEST_DIFF and len(b) <= LONGEST_DIFF
        out += islice(_ndiff(a, b), most) if short else [f"- {x}" for x in a[:most]] + [f"+ {x}" for x in b[:most]]
        out += [f"  {x}" for x in end[:most]]
    return out[:most]


@F.pandas_udf(LongType())
def changed_characters(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Characters that a line diff of single characters adds or takes away; for failing rows only."""

    def changed(x, y):
        _, a, b, _ = _middles(x or "", y or "")
        return len(a) + len(b) if max(len(a), len(b)) > LONGEST_DIFF or not (a and b) else sum(d[0] in "+-" for d in _ndiff(a, b))

    return pd.Series([changed(a, b) for a, b in zip(expected, actual)])


@F.pandas_udf(StringType())
def diff_sample(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """The first 100 entries of the diff."""
    return pd.Series([None if b is None else "".join(diff_of(a, b, 100)) for a, b in zip(expected, actual)])


def failed_samples(rows: DataFrame, k: int = 10) -> DataFrame:
    """The first k failed segments of each document, in their order, with their texts and a sample of the diff; a segment that is missing has an error instead.

    rows: integrity_rows of originals with seg_ord; segments without one, which no original has, come last. Each task passes on no more than k
    of a document."""
    first = Window.partitionBy("doc_id").orderBy(F.col("seg_ord").asc_nulls_last(), "segment_id")
    bad = rows.where("not ok").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    error = F.when(F.col("actual").isNull(), "Segment missing from redacted document")
    return bad.select("doc_id", "segment_id", "seg_ord", "rank", error.alias("error"), "original", "expected", "actual", diff_sample("expected", "actual").alias("diff_sample"))


def integrity_report(rows: DataFrame) -> DataFrame:
    """One row for each document."""
    bad = rows.where("not ok").select("doc_id", changed_characters("expected", "actual").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("segments_checked"), F.count_if(F.expr("n_spans > 0")).alias("segments_with_expected_redactions"), F.count_if(F.expr("not ok")).alias("segments_with_unexpected_changes"), F.sum(F.coalesce(F.length("original"), F.lit(0))).alias("total_original_characters"), F.sum(F.coalesce("n_spans", F.lit(0))).alias("total_approved_spans"))
    out = sums.join(bad, "doc_id", "left").withColumn("unauthorized_changed_characters", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
    rate = F.when(F.col("total_original_characters") > 0, F.col("unauthorized_changed_characters") / F.col("total_original_characters")).otherwise(0.0)
    out = out.withColumn("unauthorized_change_rate", rate).withColumn("non_pii_preservation_rate", F.greatest(F.lit(0.0), 1 - rate))
    return out.withColumn("status", F.when((F.col("segments_with_unexpected_changes") == 0) & (F.col("unauthorized_changed_characters") == 0), "PASS").otherwise("FAIL"))


def semantic_diff(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Approved replacements, and what else changed: whole texts before and after."""
    a = matches.where("approved").select("doc_id", "segment_id", F.lit("APPROVED_REDACTION").alias("kind"), F.col("text").alias("before"), F.col("replacement").alias("after"))
    b = rows.where("not ok and actual is not null").select("doc_id", "segment_id", F.lit("UNEXPECTED_CHANGE").alias("kind"), F.col("expected").alias("before"), F.col("actual").alias("after"))
    return a.unionByName(b)


def download_gate(report: DataFrame) -> None:
    """Raises if any document failed."""
    if report.where("status <> 'PASS'").limit(1).count():
        raise PermissionError("a document failed its integrity check")


def _texts(df: DataFrame) -> DataFrame:
    return df.select("entity_type", F.lower(strip(F.col("text"))).alias("t")).distinct()


def metrics_by_type(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Over distinct texts: gold, predicted, tp, fp, fn, and the rates, null where there is nothing to divide."""
    for flag, keep in (("verified", "coalesce(verified, true)"), ("exclude_from_metrics", "not coalesce(exclude_from_metrics, false)")):
        gold = gold.where(keep) if flag in gold.columns else gold
    g, p = _texts(gold.where("text <> 'ABSENT'")).withColumn("g", F.lit(1)), _texts(predicted).withColumn("p", F.lit(1))
    kinds = F.array(*map(F.lit, SCORED_TYPES))
    types = gold.sparkSession.range(1).select(F.explode(kinds).alias("entity_type"))
    both = g.join(p, ["entity_type", "t"], "full").where(F.col("entity_type").isin(SCORED_TYPES))
    n = both.groupBy("entity_type").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count_if(F.expr("g = 1 and p = 1")).alias("tp"))
    n = types.join(n, "entity_type", "left").fillna(0, ["gold", "predicted", "tp"]).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("gold") - F.col("tp"))
    return _rates(n, F.col("gold") > 0)


def _rates(n: DataFrame, has_gold) -> DataFrame:
    div = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    some = has_gold | (F.col("predicted") > 0)
    out = n.withColumn("precision", F.when(some, div(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", F.when(has_gold, div(F.col("tp"), F.col("tp") + F.col("fn"))))
    f1 = div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return out.withColumn("f1", F.when(some, f1)).withColumn("accuracy", F.when(some, div(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))))


def metrics_micro(by_type: DataFrame) -> DataFrame:
    return _rates(by_type.agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "tp", "fp", "fn")]), F.col("gold") > 0)


def metrics_macro(by_type: DataFrame) -> DataFrame:
    """Means over the types with both precision and recall."""
    return by_type.where("precision is not null and recall is not null").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def negatives(phrases: DataFrame, predicted: DataFrame) -> DataFrame:
    """phrases(text) with whether each was left alone."""
    hit = predicted.select(F.lower(strip(F.col("text"))).alias("t")).distinct().withColumn("hit", F.lit(True))
    return phrases.withColumn("t", F.lower(strip(F.col("text")))).join(hit, "t", "left").select("text", F.col("hit").isNull().alias("preserved"))


def negatives_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.expr("preserved")).alias("preserved"), F.count_if(F.expr("not preserved")).alias("violated"), F.coalesce(F.count_if(F.expr("preserved")) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("pass_rate"))


def residual(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings but those that equal a known synthetic value, of whatever type, or, where it is longer than four characters, contain it
    or lie in it; in any case, without blanks around.

    Distinct texts meet by equality first; what is left by the rarest pieces (see `substrings.holding`), in both directions."""
    text = lambda c: F.lower(strip(F.col(c)))
    v = kept(known.select(text("replacement").alias("value")).where("value is not null").distinct(), "known-values")
    f = kept(findings.select(text("text").alias("text")).distinct().join(apart(v.withColumnRenamed("value", "text")), "text", "left_anti"), "findings")
    long = v.where(F.length("value") > 4)
    holds = holding(f, long).withColumnRenamed("text", "value")
    lies = holding(long.withColumnRenamed("value", "text"), f.withColumnRenamed("text", "value"), "value")
    gone = v.union(holds).union(lies).distinct().withColumnRenamed("value", "_residual_text")
    return findings.withColumn("_residual_text", text("text")).join(apart(gone), "_residual_text", "left_anti").drop("_residual_text")


def spot_check(originals: DataFrame, output: DataFrame) -> DataFrame:
    """Originals (doc_id, text) that still occur in their document's output, in any case.

    output: doc_id, text, a row for each text; with seg_ord the rows of a document are segments of one text, which is never put together
    (a capital sigma at the end of 1,024 segments counts as the end of a word)."""
    rows = kept(originals.select("doc_id", "text", F.lower("text").alias("value")).where("text is not null").distinct(), "originals")
    values = rows.select("doc_id", "value").distinct()
    longest = rows.agg(F.max(F.length("value"))).first()[0] or 0
    windows = kept((segment_windows if "seg_ord" in output.columns else text_windows)(output, longest).withColumn("window", F.monotonically_increasing_id()), "windows")
    blank = values.where("value = ''").join(apart(windows.select("doc_id").distinct()), "doc_id", "left_semi")
    return rows.join(apart(lying(values, windows).unionByName(blank)), ["doc_id", "value"], "left_semi").select("doc_id", "text").distinct()


def audit_log(matches: DataFrame, raw_text: bool = False) -> DataFrame:
    """A row for each replaced span, with a hash of the original instead of it."""
    return matches.select("doc_id", "segment_id", "entity_type", *(["text"] if raw_text else []), "start", "end", "replacement", F.round("confidence", 4).alias("confidence"), "source", hash_text(F.col("text")).alias("original_hash"))


def audit_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.expr("approved")).alias("approved"), F.count_if(F.expr("not approved")).alias("rejected"), F.count_if(F.expr("tier = 'HIGH'")).alias("high"), F.count_if(F.expr("tier = 'MEDIUM'")).alias("medium"), F.count_distinct("entity_type").alias("n_types"))
