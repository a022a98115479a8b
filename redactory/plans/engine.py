"""The steps in a row: detect, resolve, replace, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.text import match_rows, splice, valid_spans
from redactory.operators import resolve
from redactory.operators.detect import Config, scan
from redactory.operators.replace import first_seen, numbered, with_replacements


def detected(segments: DataFrame, config: Config = Config(), profile: str = "engine") -> DataFrame:
    """segments with resolved matches. profile "cli": spans are validated, resolved by priority, and all approved."""
    rows = scan(segments, config)
    if profile == "cli":
        valid = valid_spans(F.col("text"), F.col("matches"))
        return rows.withColumn("matches", F.transform(resolve.by_priority(valid), lambda m: m.withField("approved", F.lit(True))))
    return rows.withColumn("matches", resolve.by_start(F.col("matches")))


def replaced(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Matches with replacements; only TOKEN, which numbers them, and first_seen shuffle."""
    if config.strategy != "TOKEN":
        out = with_replacements(rows, config.strategy, config.seed)
        return first_seen(out, config.seed) if config.first_seen and config.strategy not in ("MASK", "CATEGORY_LABEL") else out
    flat = numbered(match_rows(rows, "doc_id", "segment_id", "seg_ord"), None if config.tokens_across else "doc_id")
    names = [c for c in flat.columns if c not in ("doc_id", "segment_id", "seg_ord")]
    back = flat.groupBy("doc_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("start", F.struct(*names).alias("m")))).alias("x"))
    kind = "array<" + back.select(F.transform("x", lambda x: x["m"]).alias("m")).schema["m"].dataType.elementType.simpleString() + ">"
    joined = rows.drop("matches").join(back, ["doc_id", "segment_id"], "left")
    return joined.withColumn("matches", F.coalesce(F.transform("x", lambda x: x["m"]), F.array().cast(kind))).drop("x")


def approved(matches):
    return F.filter(matches, lambda m: m["approved"])


def redacted(rows: DataFrame) -> DataFrame:
    """rows with `redacted`: the text with the approved matches replaced."""
    return rows.withColumn("redacted", splice(F.col("text"), approved(F.col("matches"))))


def redact(segments: DataFrame, config: Config = Config(), profile: str = "engine") -> DataFrame:
    return redacted(replaced(detected(segments, config, profile), config))


def redact_text(spark: SparkSession, text: str, config: Config = Config()) -> str:
    """One text; all that is found is replaced, approved or not."""
    rows = spark.createDataFrame([("text", "text", 0, text)], "doc_id string, segment_id string, seg_ord int, text string")
    return replaced(detected(rows, config), config).select(splice(F.col("text"), F.col("matches"))).first()[0]
