"""Benchmark decontamination: items whose word shingles a document contains, with DataFrame functions only.

An item is contained in a document if at least `percent` hundredths of its distinct five-word shingles occur there. Items are
partitioned by size (powers of two of their shingle counts). Of each item the least min-hashes are kept, so many that a
document which contains the item must hold `hits` of them: with n shingles of which need = ceil(percent * n / 100) must
occur, k minima leave at least k - (n - need). k is set by the upper end of the item's size class, and so is the number of hits that a document must have in a class before
its items are looked at. Documents' distinct shingle hashes probe the sketches of all classes at one look-up a shingle, which
finds short items in long documents; hits are counted by document and class, then, where they reach the class's
threshold, by item; pairs with enough hits are verified by exact containment of the shingles themselves.

Words are [^\\x20\\x09-\\x0D]+ with ASCII letters in lower case. Items with fewer than five words (or null) have no shingles
and are contained nowhere; neither do short or null documents contain any. Rows of a repeated id count as one document or
item with the best match of its rows. Rows without an id are dropped, extra columns ignored. The sketches are broadcast only
if their counted size allows it; with more items the look-up is a shuffled join. An empty table gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import forget, sized, stored

SIZE = 5


def words(text: Column) -> Column:
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, "[\\x20\\x09-\\x0D]+"), "")


def _hashes() -> Column:
    """Hash of the five words from each position, from the column `w` of words' hashes."""
    five = ", ".join(f"w[i + {k}]" for k in range(SIZE))
    return F.expr(f"case when size(w) >= {SIZE} then transform(sequence(0, size(w) - {SIZE}), i -> xxhash64({five})) else cast(array() as array<bigint>) end")


def _texts() -> Column:
    """The shingles themselves, from the column `words`."""
    return F.expr(f"case when size(words) >= {SIZE} then transform(sequence(1, size(words) - {SIZE - 1}), i -> concat_ws(' ', slice(words, i, {SIZE}))) else cast(array() as array<string>) end")


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """item_id, n, texts, hits, least (the minima) of the items (item_id, text) that have shingles."""
    rows = items.withColumn("words", words(F.col("text"))).withColumn("texts", F.array_distinct(_texts()))
    rows = rows.withColumn("w", F.expr("transform(words, x -> xxhash64(x))")).withColumn("hashes", F.array_distinct(_hashes()))
    rows = rows.withColumn("n", F.size("texts")).where("n > 0")
    rows = rows.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    top = (F.pow(F.lit(2), F.col("size_class") + 1) - 1).cast("int")
    need = lambda n: F.ceil(n * percent / 100).cast("int")
    rows = rows.withColumn("k", F.least("n", top - need(top) + 2))
    rows = rows.withColumn("least", F.expr("transform(slice(array_sort(transform(hashes, h -> named_struct('m', xxhash64(h, 7L), 'h', h))), 1, k), x -> x.h)"))
    rows = rows.withColumn("hits", F.greatest(F.lit(1), F.size("least") - (F.col("n") - need(F.col("n")))))
    return rows.select("item_id", "n", "texts", "hits", "size_class", "least")


def contained(documents: DataFrame, benchmark: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair that reaches percent."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
    known = stored(sketches(items, percent), "bench-items")
    # a row for each minimum and class; within a class the threshold is that of its item with the fewest hits to reach
    minima = known.select("size_class", "item_id", "hits", F.explode("least").alias("s")).groupBy("s", "size_class").agg(F.collect_set(F.struct("item_id", "hits")).alias("items"))
    minima = stored(minima, "bench-minima")
    least = known.groupBy("size_class").agg(F.min("hits").alias("class_hits"))  # a row for each power of two
    hashed = docs.withColumn("words", words(F.col("text"))).withColumn("w", F.expr("transform(words, x -> xxhash64(x))"))
    probes = hashed.select("doc_id", F.explode(F.array_distinct(_hashes())).alias("s"))
    found = stored(probes.join(sized(minima, F.size("items") * 24), "s").select("doc_id", "s", "size_class", "items"), "bench-found")
    classes = found.groupBy("doc_id", "size_class").agg(F.count_distinct("s").alias("n")).join(F.broadcast(least), "size_class").where("n >= class_hits")
    classes = stored(classes.select("doc_id", "size_class"), "bench-classes")
    pairs = found.join(sized(classes), ["doc_id", "size_class"], "left_semi").select("doc_id", "s", F.inline("items"))
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.count("s").alias("found"), F.min("hits").alias("hits")).where("found >= hits")
    asked = stored(pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids")), "bench-asked")
    some = docs.join(sized(asked, F.size("item_ids") * 8), "doc_id").withColumn("words", words(F.col("text"))).withColumn("shingles", F.array_distinct(_texts()))
    both = some.select("doc_id", "shingles", F.explode("item_ids").alias("item_id")).join(sized(known.select("item_id", "n", "texts"), F.expr("aggregate(texts, 0L, (a, x) -> a + 24 + octet_length(x))")), "item_id")
    both = both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), F.size(F.array_intersect("texts", "shingles")).cast("long").alias("n_shared"))
    both = both.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).groupBy("doc_id", "item_id").agg(F.max_by("n_shingles", "n_shared").alias("n_shingles"), F.max("n_shared").alias("n_shared"))
    forget(found, minima, classes)
    return both.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def oracle_sql(percent: int = 75) -> str:
    """The same over the views documents and benchmark in DuckDB's SQL, without sketches."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase

    def side(view: str, key: str) -> str:
        return f"""SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (
  SELECT {key}, w, unnest(generate_series(1, len(w) - 4)) AS i FROM (
    SELECT {key}, list_filter(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {view} WHERE text IS NOT NULL))"""

    return f"""
WITH d AS ({side("documents", "doc_id")}), b AS ({side("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM b JOIN d ON b.s = d.s JOIN n ON n.item_id = b.item_id
GROUP BY doc_id, b.item_id, n_shingles HAVING count(*) * 100 >= n_shingles * {percent}"""
