"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Lines are what newlines separate; blank ones (nothing but \\x20 and \\x09-\\x0D) are left alone and not counted. A run of `run`
consecutive lines is a later repeat if the same lines also start at a smaller (doc_id, line). Every line that a later
repeat covers is deleted, so a longer repeated passage goes as a whole and its first occurrence stays.

Of each `run` neighbouring line hashes the least is selected (winnowing): a repeated run has the same one in both places, so
selected lines are guaranteed fingerprints, and only they are stored, with their positions and the hashes of the `run` - 1
lines on either side. Fingerprints that occur once leave. The positions of the others are joined with the first one of
their fingerprint, and the match is extended line by line both ways; what it reaches is deleted if it is a run or longer.
Runs that their fingerprint's first position doesn't match (a common line among other neighbours) meet by the hashes of
all their lines, joined with the first of them, so nothing is missed and no pairs are formed.
Fingerprints are pre-aggregated before they are shuffled and joined with one row each, and stored before that, so a line
that every document has is one row per task, or a plain exchange that Spark can split.

Null and empty texts have no lines (the kept text of a null is null, its digest that of an empty text). Documents with
fewer lines than a run lose nothing. Rows of a repeated id: the same lines at the same (doc_id, line) are no later repeat; a removal
holds for all rows of the id. Rows without an id lose nothing. Extra columns are kept by `deduplicated`. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import forget, sized, stored

_LINES = "coalesce(split(text, '\\n', -1), array())"
_NOT_BLANK = "[^\\\\x20\\\\x09-\\\\x0D]"
#: Lines are bound as an argument wherever an inner function reads them: a pushed-down filter would inline and split them for each line.
_FULL = f"transform(array(lines), x -> filter(sequence(0, size(x)), i -> i < size(x) and x[least(i, size(x) - 1)] rlike '{_NOT_BLANK}'))[0]"


def _with_lines(docs: DataFrame) -> DataFrame:
    """lines, and `full`: the positions of those that aren't blank."""
    return docs.withColumn("lines", F.expr(_LINES)).withColumn("full", F.expr(f"case when size(lines) > 0 then {_FULL} else cast(array() as array<int>) end"))


def _fingerprints(run: int) -> str:
    """Of the array `lines`: the selected positions, the runs that selected each (from lo to hi), and the hashes around it, nearest first."""
    pick = f"-array_min(transform(sequence(p, p + {run - 1}), j -> named_struct('h', h[j], 'back', -j))).back"
    own = f"filter(sequence(greatest(0, q - {run - 1}), least(q, size(picks) - 1)), p -> picks[p] = q)"
    left = f"reverse(slice(h, greatest(0, q - {run - 1}) + 1, least(q, {run - 1})))"
    row = f"named_struct('at', q, 'print', h[q], 'lo', array_min({own}), 'hi', array_max({own}), 'left', {left}, 'right', slice(h, q + 2, {run - 1}))"
    # bound as arguments: a column of their own would be inlined into the inner functions and evaluated for each line
    picked = f"transform(array(transform(sequence(0, size(h) - {run}), p -> {pick})), picks -> transform(array_distinct(picks), q -> {row}))[0]"
    return f"case when size(lines) >= {run} then transform(array(transform(lines, x -> xxhash64(x))), h -> {picked})[0] end"


def _long_runs(run: int, words: int) -> str:
    """Of the array `lines`: the runs shorter than `run` with more than `words` words, each its own fingerprint of at least 128 bits."""
    out = []
    for k in range(1, run):
        many = f"aggregate(slice(counts, p + 1, {k}), 0, (a, x) -> a + x) > {words}"
        key = "array(xxhash64(kept[p]), xxhash64(7L, kept[p]))" if k == 1 else f"transform(slice(kept, p + 1, {k}), x -> xxhash64(x))"
        each = f"transform(filter(sequence(0, size(kept) - {k}), p -> {many}), p -> named_struct('p', p, 'size', {k}, 'key', {key}))"
        bound = f"transform(array(lines), kept -> transform(array(transform(kept, x -> regexp_count(x, '{_NOT_BLANK}+'))), counts -> {each})[0])[0]"
        out.append(f"coalesce(case when size(lines) >= {k} then {bound} end, array())")
    return f"flatten(array({', '.join(out)}))"


def _same(a: str, b: str) -> str:
    """How many values two arrays have in common from their start on."""
    where = f"array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false)"
    return f"cast(case when {where} = 0 then size({a}) else {where} - 1 end as int)"


def later_runs(documents: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """(doc_id, runs): start and size of the later repeats, counted in lines that aren't blank."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    docs = docs.select("doc_id", F.expr(f"filter({_LINES}, x -> x rlike '{_NOT_BLANK}')").alias("lines"))
    # the outer form, of which no filter is inferred that would make the fingerprints twice
    rows = docs.select("doc_id", F.explode_outer(F.expr(_fingerprints(run))).alias("w")).where("w is not null").select("doc_id", "w.*")
    rows = stored(rows, "line-prints")
    first = rows.groupBy("print").agg(F.min(F.struct("doc_id", "at", "left", "right")).alias("first"), F.max(F.struct("doc_id", "at")).alias("last"))
    first = first.where(F.struct("first.doc_id", "first.at") < F.col("last")).select("print", "first")
    first = stored(first, "line-first")
    both = rows.join(sized(first, F.lit(32 * run)), "print").where(F.struct("doc_id", "at") > F.struct("first.doc_id", "first.at"))
    both = both.withColumn("l", F.expr(_same("left", "first.left"))).withColumn("r", F.expr(_same("right", "first.right")))
    # what the extended match covers, then the runs of this fingerprint that it doesn't
    found = f"array(case when l + r + 1 >= {run} then named_struct('p', at - l, 'size', l + r + 1, 'key', cast(null as array<bigint>)) end)"
    out = f"filter(sequence(lo, hi), p -> p < at - l or p > at + r - {run - 1})"
    key = f"slice(concat(reverse(left), array(print), right), size(left) - (at - p) + 1, {run})"
    rest = f"transform({out}, p -> named_struct('p', p, 'size', {run}, 'key', {key}))"
    told = both.select("doc_id", F.explode(F.expr(f"concat({found}, {rest})")).alias("w")).where("w is not null").select("doc_id", "w.*")
    if words is not None:
        short = docs.select("doc_id", F.explode_outer(F.expr(_long_runs(run, words))).alias("w")).where("w is not null").select("doc_id", "w.*")
        told = told.unionByName(short)
    told = stored(told, "line-told")
    rest = told.where("key is not null")
    least = rest.groupBy("key").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.max(F.struct("doc_id", "p")).alias("last")).where("first < last").select("key", "first")
    least = stored(least, "line-least")
    later = rest.join(sized(least, F.lit(32 * run)), "key").where(F.struct("doc_id", "p") > F.col("first")).select("doc_id", "p", "size")
    later = later.union(told.where("key is null").select("doc_id", "p", "size"))
    later = stored(later.groupBy("doc_id").agg(F.collect_set(F.struct("p", "size")).alias("runs")), "line-later")
    forget(rows, first, told, least)
    return later


def deduplicated(documents: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, counts: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """documents with the text that is left, and in the columns `counts` the lines that aren't blank and those deleted."""
    later = later_runs(documents, run, id_col, text_col, words)
    later = sized(later, F.size("runs") * 32).toDF("_id", "_runs")
    names = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    rows = _with_lines(rows.join(later, "_id", "left"))
    gone = "transform(array(full), x -> array_distinct(flatten(transform(_runs, r -> slice(x, r.p + 1, r.size)))))[0]"
    rows = rows.withColumn("_gone", F.expr(f"case when _runs is null then cast(array() as array<int>) else {gone} end"))
    kept = "transform(array(lines), x -> array_join(transform(array_except(sequence(0, size(x) - 1), _gone), i -> x[i]), '\n'))[0]"
    left = F.expr(f"case when size(_gone) = 0 then text else {kept} end")
    return rows.select(*[left.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names], F.size("full").cast("long").alias(counts[0]), F.size("_gone").cast("long").alias(counts[1]))


def line_dedup(documents: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): lines that aren't blank, those deleted, and the digest of the text that is left."""
    out = deduplicated(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, words=words)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle_sql(run: int = 3, words: int | None = None) -> str:
    """The same over the view documents in DuckDB's SQL, by comparing whole runs."""
    short = [] if words is None else range(1, run)
    many = {k: " + ".join(f"lead(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')), {j}) OVER w" for j in range(k)) for k in short}
    sums = "".join(f", coalesce({many[k]}, 0) > {words} AS many{k}" for k in short)
    laters = "".join(f", many{k} AND row_number() OVER (PARTITION BY {', '.join([f'many{k}', 'line', *(f'l{j}' for j in range(1, k))])} ORDER BY doc_id, p) > 1 AS later{k}" for k in short)
    covers = "".join(f" OR coalesce(lag(later{k}, {j}) OVER w, false)" for k in short for j in range(k))
    names = ", ".join(f"lead(line, {k}) OVER w AS l{k}" for k in range(1, run))
    same = ", ".join(["line", *(f"l{k}" for k in range(1, run))])
    cover = " OR ".join(f"lag(later, {k}) OVER w" for k in range(1, run))
    return f"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs AS (SELECT *, {names}{sums} FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT *, l{run - 1} IS NOT NULL AND row_number() OVER (PARTITION BY {same} ORDER BY doc_id, p) > 1 AS later{laters} FROM runs),
covered AS (SELECT doc_id, i, coalesce(later OR {cover}, later){covers} AS gone FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
kept AS (SELECT s.doc_id, count(c.i) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed, coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.i = c.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
