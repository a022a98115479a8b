"""Overlap resolution within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions import vocabulary as V
from redactory.functions.text import MATCHES, none, overlaps


def _sorted(matches: Column, key) -> Column:
    """A stable order: ties keep the array's order."""
    keyed = F.transform(matches, lambda m, i: F.struct(key(m).alias("k"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def _length(m):
    return m["end"] - m["start"]


def _greedy(ordered: Column) -> Column:
    return F.aggregate(ordered, none(MATCHES), lambda acc, m: F.when(F.exists(acc, lambda k: overlaps(m["start"], m["end"], k)), acc).otherwise(F.concat(acc, F.array(m))))


def by_start(matches: Column) -> Column:
    """Earliest first, then longest, then surest; each that overlaps none kept before it."""
    ordered = _sorted(matches, lambda m: F.struct(m["start"], -_length(m), -m["confidence"]))
    start = F.struct(F.lit(-1).alias("end"), none(MATCHES).alias("out"))
    # in this order only the last kept can overlap
    return F.aggregate(ordered, start, lambda acc, m: F.when(m["start"] >= acc["end"], F.struct(m["end"].alias("end"), F.concat(acc["out"], F.array(m)).alias("out"))).otherwise(acc), lambda acc: acc["out"])


def by_priority(matches: Column) -> Column:
    """By rank of the entity type, then surest, longest, earliest; the result by start."""
    rank = F.lit(99)
    for i, kind in reversed(list(enumerate(V.PRIORITY.split(), 1))):
        rank = (lambda i, kind, rest: lambda m: F.when(m["entity_type"] == kind, i).otherwise(rest(m) if callable(rest) else rest))(i, kind, rank)
    kept = _greedy(_sorted(matches, lambda m: F.struct(rank(m), -m["confidence"], -_length(m), m["start"])))
    return _sorted(kept, lambda m: F.struct(m["start"]))
