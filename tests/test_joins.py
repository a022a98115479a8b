"""Substring joins, the dictionary of first occurrences and numbering in two passes, against plain Python."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redactory.operators import audit, replace, substrings
from redactory.operators.detect import Config
from redactory.plans import engine
from redactory.sources import writers
from redactory.sources.shared import kept

SEGMENT = "doc_id string, segment_id string, seg_ord int, text string"


def kept_findings(findings, known):
    known = {k.lower().strip() for k in known if k is not None}
    left = lambda t: not any(k == t or len(k) > 4 and (k in t or t and t in k) for k in known)
    return sorted(x for x in findings if left(x.lower().strip()))


@pytest.mark.parametrize("hot", [1000, 2])
def test_holding(spark, hot):
    r = random.Random(hot)
    word = lambda a, b: "".join(r.choice("abÅé") for _ in range(r.randint(a, b)))
    texts, values = sorted({word(0, 14) for _ in range(120)} | {"", "aaaaaaaa"}), sorted({word(1, 9) for _ in range(120)} | {"", "aaaaa", "zzzzzz"})
    t, v = spark.createDataFrame([(x,) for x in [*texts, None]], "text string"), spark.createDataFrame([(x,) for x in [*values, None]], "value string")
    pairs = [(x, y) for x in texts for y in values if y and y in x]
    assert sorted(x[0] for x in substrings.holding(t, v, "text", 5, hot).collect()) == sorted({x for x, _ in pairs})
    assert sorted(map(tuple, substrings.holding(t, v, "pairs", 5, hot).collect())) == sorted(pairs)
    assert sorted(x[0] for x in substrings.holding(t, v, "value", 5, hot).collect()) == sorted({y for _, y in pairs})


def test_residual_against_brute_force(spark):
    r = random.Random(2)
    known = [f"GB29NWBK601613{r.randint(10**7, 10**8 - 1)}" for _ in range(60)] + [f"Plot {k}, Mill Industrial Area, Sector {k % 20 + 1}, Pune" for k in range(60)] + ["abcd", "abcde", "Jo", None]
    findings = [f"No {known[3]}", known[4].upper(), known[5][4:15], "GB29NWBK", "gb29nwbk60161", "Plot", "plot 7, mill", "abcd", "abcdef", "xabcdx", "jo", "joe", " Industrial Area ", "Pune 4", "lot", "GB29NWBK60161399999999", "a", "q"]
    f = spark.createDataFrame([("X", x, 1) for x in findings], "entity_type string, text string, f int")
    k = spark.createDataFrame([("X", x) for x in known], "entity_type string, replacement string")
    assert sorted(x.text for x in audit.residual(f, k).collect()) == kept_findings(findings, known)


def test_residual_of_many_values_of_one_kind(spark):
    """100,000 IBANs and as many addresses, all with the same beginnings, against findings of the same kinds."""
    n = 100_000
    iban, place = F.concat(F.lit("GB29NWBK601613"), (F.col("id") * 7 + 10_000_000).cast("string")), F.concat(F.lit("Plot "), F.col("id"), F.lit(", Mill Industrial Area, India"))
    known = spark.range(n).select(iban.alias("replacement")).union(spark.range(n).select(place.alias("replacement")))
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("to "), iban)).otherwise(F.concat(F.lit("GB29NWBK601613"), (F.col("id") * 7 + 10_000_003).cast("string"))).alias("text"))
    rows = rows.union(spark.range(n).select(F.when(F.col("id") % 2 == 0, F.substring(place, 1, 25)).otherwise(F.concat(F.lit("Plot x"), F.col("id"), F.lit(", Mill Industrial Area"))).alias("text")))
    began = time.time()
    left = audit.residual(rows, known).select(F.count("*"), F.count_if(F.col("text").startswith("GB")), F.count_if(F.col("text").startswith("Plot x"))).first()
    assert tuple(left) == (n, n // 2, n // 2)
    assert time.time() - began < 200


def test_map_keeps_the_first(spark):
    rows = [("a", 0, 5, "COMPANY", "Acme Private Limited"), ("a", 1, 0, "COMPANY", "ACME PRIVATE LIMITED"), ("a", 1, 9, "COMPANY", " acme llp"), ("b", 0, 0, "COMPANY", "Acme LLP"), ("a", 2, 0, "PERSON", "ADA QUILL"), ("b", 9, 0, "PERSON", "Ada Quill"), ("b", 0, 3, "PHONE", "+91 98765 43210"), ("c", 0, 0, "PERSON", "Élan Vale")]
    m = spark.createDataFrame(rows, "doc_id string, seg_ord int, start int, entity_type string, text string").repartition(3)
    made = {(k, t): v for k, t, v in m.select("entity_type", "text", replace.synthetic(F.col("entity_type"), F.col("text"))).collect()}
    expected = {("COMPANY", "acme private limited"): made["COMPANY", "Acme Private Limited"], ("COMPANY", "acme llp"): made["COMPANY", " acme llp"], ("PERSON", "ada quill"): made["PERSON", "ADA QUILL"], ("PHONE", "+91 98765 43210"): made["PHONE", "+91 98765 43210"], ("PERSON", "élan vale"): made["PERSON", "Élan Vale"]}
    assert {(a, b): c for a, b, c in replace.replacement_map(m).collect()} == expected
    assert made["COMPANY", "Acme Private Limited"].endswith(" Private Limited") and made["PERSON", "ADA QUILL"].isupper()


def test_no_replacement_of_ours_is_a_leak(spark):
    texts = ["Vendor: Acme Private Limited", "Vendor: ACME PRIVATE LIMITED and more", "Vendor: Birch LLP", "Contact Person: ADA QUILL", "Contact Person: Ada Quill", "Mobile: +91 98765 43210"]
    rows = spark.createDataFrame([("d", f"s{i}", i, t) for i, t in enumerate(texts)], SEGMENT)
    config = Config(first_seen=True, categories=("PERSON", "COMPANY", "PHONE"))
    done = kept(engine.replaced(engine.detected(rows, config), config), "test")
    m = audit.explode_matches(done)
    again = engine.detected(engine.redacted(done).select("doc_id", "segment_id", "seg_ord", F.col("redacted").alias("text")), config)
    known = replace.replacement_map(m)
    assert audit.residual(audit.explode_matches(again), known).count() == 0
    by = {(x.entity_type, x.norm_text): x.replacement for x in known.collect()}
    assert all(x.replacement == by[x.entity_type, x.text.strip().lower()] for x in m.collect()) and m.count() >= 5


@pytest.mark.parametrize("doc", ["doc_id", None])
def test_numbers_in_two_passes(spark, doc):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 60), r.randint(0, 40), r.choice(["EMAIL", "PHONE"]), k) for k in range(1500)]
    rows = [(d, s, a, a + k, t, k) for d, s, a, t, k in rows]
    m = spark.createDataFrame(rows, "doc_id string, seg_ord int, start int, end int, entity_type string, k int").repartition(5)
    seen, expected = Counter(), {}
    for d, s, a, e, t, k in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", *x[1:4])):
        seen[(d if doc else 0, t)] += 1
        expected[k] = f"<{t}_{seen[(d if doc else 0, t)]:03d}>"
    for size in (100_000, 50):
        assert {x.k: x.replacement for x in replace.numbered(m, doc, rows_a_range=size).collect()} == expected
    assert replace.numbered(m.limit(0), doc).count() == 0


def test_samples_and_diffs(spark):
    import difflib

    r = random.Random(6)
    rows = [(f"d{k % 2}", f"s{k}", k, "".join(r.choice("abc ") for _ in range(r.choice([3, 40, 300])))) for k in range(30)]
    change = lambda t, k: None if k % 7 == 0 else t if k % 3 == 0 else t[: len(t) // 2] + "XY" + t[len(t) // 2 + k % 2 :]
    orig = spark.createDataFrame(rows, SEGMENT).withColumn("matches", F.array().cast("array<struct<start:int,end:int,replacement:string>>"))
    out = spark.createDataFrame([(d, s, c) for d, s, k, t in rows if (c := change(t, k)) is not None], "doc_id string, segment_id string, text string")
    checked = kept(audit.integrity_rows(orig, out), "rows")
    got = audit.failed_samples(checked, 5).orderBy("doc_id", "rank").collect()
    bad = [(d, s, k, t, change(t, k)) for d, s, k, t in rows if change(t, k) != t]
    expected = [x for d in ("d0", "d1") for x in [y for y in bad if y[0] == d][:5]]
    assert [(x.doc_id, x.segment_id, x.seg_ord, x.expected, x.actual) for x in got] == expected and [x.rank for x in got] == [1, 2, 3, 4, 5] * 2
    for x in got:
        assert (x.error is not None) == (x.actual is None) == (x.diff_sample is None)
        if x.actual is not None:
            assert x.diff_sample == "".join(list(difflib.ndiff(x.expected, x.actual))[:100])
    n = {x.doc_id: x.unauthorized_changed_characters for x in audit.integrity_report(checked).collect()}
    assert n == {d: sum(sum(y[0] in "+-" for y in difflib.ndiff(t, c or "")) for e, _, _, t, c in bad if e == d) for d in ("d0", "d1")}
    assert len(audit.diff_of("a" * 9000, "b" * 9000)) == 18000
    kinds = Counter(x.kind for x in audit.semantic_diff(checked, spark.createDataFrame([("d0", "s1", True, "t", "r")], "doc_id string, segment_id string, approved boolean, text string, replacement string")).collect())
    assert kinds == {"APPROVED_REDACTION": 1, "UNEXPECTED_CHANGE": sum(c is not None for *_, c in bad)}


def test_links(spark):
    m = spark.createDataFrame([("a", 0, 0, "EMAIL", "Bob@x.org", "n1@e.com"), ("a", 1, 0, "EMAIL", "ob@x.org", "n2@e.com"), ("a", 2, 0, "EMAIL", "bob@x.org", "n3@e.com"), ("b", 0, 0, "EMAIL", "al@x.org", "n4@e.com"), ("b", 0, 5, "PHONE", "mailto", "no")], "doc_id string, seg_ord int, start int, entity_type string, text string, replacement string")
    links = spark.createDataFrame([("a", "MAILTO:Bob@x.org?q=A", 1), ("a", "mailto:al@x.org", 2), ("b", "https://h/?to=AL@x.org&al@X.org", 3), ("b", "Mailto:bob@x.org", 4), ("b", None, 5)], "doc_id string, target string, value int")
    got = {x.value: x.target for x in writers.patch_any_links(links, m).collect()}
    assert got == {1: "mailto:bn2@e.com?q=a", 2: "mailto:al@x.org", 3: "https://h/?to=n4@e.com&n4@e.com", 4: "Mailto:bob@x.org", 5: None}
    exact = spark.createDataFrame([("a", "mailto:BOB@x.org?s=1"), ("b", "mailto:bob@x.org")], "doc_id string, target string")
    assert sorted(x.target for x in writers.patch_links(exact, m.where("seg_ord = 0")).collect()) == ["mailto:bob@x.org", "mailto:n1@e.com"]


def test_text_in_parts(spark):
    rows = [("a", i, f"line {i} é\n") for i in range(10)] + [("b", 0, ""), ("c", 3, "end")]
    parts = writers.text_parts(spark.createDataFrame(rows, "doc_id string, seg_ord int, text string").repartition(3), 4).orderBy("doc_id", "part").collect()
    for d in "abc":
        own, whole = [x for x in parts if x.doc_id == d], "".join(t for k, _, t in rows if k == d)
        assert "".join(x.text for x in own) == whole and len(own) == (3 if d == "a" else 1)
        assert all(whole.encode()[x.offset : x.offset + x.n_bytes] == x.text.encode() for x in own)
