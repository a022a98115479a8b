"""Detectors: from a text Column to an array of matches. A match that a gate rejects still uses up its text."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions import vocabulary as V
from redactory.functions.text import MATCHES, SPANS, anchored, before, blank, contains_any, luhn, none, overlaps, reused, snippet, span, spans_of, strip, tier

#: What every text with such a match has.
DIGIT = r"\p{Nd}"
FIRM = r"(?iu)(?U:\s)(?:limited|(?:pvt\.?(?U:\s*))?ltd|llp|inc|corp|corporation|llc|gmbh|s\.?a|a\.?g|holdings?)(?U:\b)"
NAMES = r"[A-Z][a-z]+(?U:[^\S\r\n]+)[A-Z][a-z]"
FORMS = "Limited Ltd LLP Inc Corp LLC Bank Securities Solutions Services"

ORDER = ["EMAIL", "PHONE", "CREDIT_CARD", "SSN", "IP_ADDRESS", "PAN", "UPI_ID", "IBAN", "PERSON", "COMPANY", "ADDRESS", "DOB"]


@dataclass(frozen=True)
class Custom:
    name: str
    pattern: str
    confidence: float = 0.9


@dataclass(frozen=True)
class Config:
    """What to look for; read when the plan is built. person_ner: a function from a text to the (start, end) of names.

    first_seen: synthetic values are those of each value's first occurrence; tokens_across: tokens are numbered across documents."""

    categories: tuple[str, ...] = tuple(ORDER)
    packs: tuple[str, ...] = ("generic", "legal", "finance")
    strategy: str = "SYNTHETIC"
    threshold: float = 0.85
    seed: int = 42
    custom: tuple[Custom, ...] = ()
    protected_terms: tuple[str, ...] = ()
    person_ner: object = field(default=None, compare=False)
    first_seen: bool = False
    tokens_across: bool = False


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def is_protected(text: Column, start: Column, end: Column, held: Column, pattern: str) -> Column:
    inside = strip(F.substring(text, start + 1, end - start)).rlike(rf"(?iU)^(?:{pattern})$")
    return F.exists(held, lambda p: overlaps(start, end, p)) | inside


def kept(spans: Column, text: Column, held: Column, pattern: str) -> Column:
    return F.filter(spans, lambda s: ~is_protected(text, s["start"], s["end"], held, pattern))


def scored(spans: Column, text: Column, kind: str, confidence, source: str) -> Column:
    """Spans as matches; confidence is a number or made from the span."""

    def one(s):
        c = (confidence(s) if callable(confidence) else F.lit(confidence)).cast("double")
        return F.struct(F.lit(kind).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), c.alias("confidence"), tier(c).alias("tier"), F.lit(source).alias("source"), snippet(text, s["start"], s["end"]).alias("context"), F.lit(ORDER.index(kind) if kind in ORDER else len(ORDER)).alias("det_ord"), F.lit(True).alias("approved"))

    return F.transform(spans, one).cast(MATCHES)


def email(text, held, pat):
    s = F.filter(spans_of(text, V.EMAIL, needs="@"), lambda m: ~contains_any(F.lower(m["text"]), V.FILE_ENDINGS.split()))
    return scored(kept(s, text, held, pat), text, "EMAIL", 0.99, "regex_rfc5322")


def phone(text, held, pat):
    s = F.filter(spans_of(text, V.PHONE, needs=DIGIT), lambda m: F.length(digits(m["text"])).between(10, 14))
    labelled = lambda m: contains_any(F.lower(before(text, m["start"], 30)), V.PHONE_LABELS.split())
    return scored(kept(s, text, held, pat), text, "PHONE", lambda m: F.when(labelled(m), 0.98).otherwise(0.88), "phonenumbers")


def credit_card(text, held, pat):
    s = F.filter(spans_of(text, V.CARD, needs=r"(?:\p{Nd}[ \-]*){13}"), lambda m: digits(m["text"]).rlike(V.CARD_ISSUER) & luhn(digits(m["text"]), 13, 19))
    return scored(kept(s, text, held, pat), text, "CREDIT_CARD", 0.99, "regex_luhn")


def ssn(text, held, pat):
    s = F.filter(spans_of(text, V.SSN, needs=DIGIT), lambda m: contains_any(F.lower(before(text, m["start"], 40)), V.SSN_LABELS.split(";")))
    return scored(s, text, "SSN", 0.98, "regex_ssn_context")


def ip_address(text, held, pat):
    octets = lambda m: F.transform(F.split(m["text"], r"\."), lambda x: x.cast("int"))
    ok = lambda m: F.forall(octets(m), lambda x: x <= 255) & F.exists(octets(m), lambda x: x > 0) & ~contains_any(F.lower(before(text, m["start"], 20)), V.VERSION_LABELS.split())
    return scored(kept(F.filter(spans_of(text, V.IPV4, needs=DIGIT), ok), text, held, pat), text, "IP_ADDRESS", 0.95, "regex_ipv4")


def pan(text, held, pat):
    s = F.filter(spans_of(text, V.PAN, False, DIGIT), lambda m: F.lit(V.PAN_KINDS).contains(F.substring(m["text"], 4, 1)))
    return scored(kept(s, text, held, pat), text, "PAN", 0.96, "regex_pan")


def upi_id(text, held, pat):
    return scored(kept(spans_of(text, V.UPI, needs="@"), text, held, pat), text, "UPI_ID", 0.96, "regex_upi")


def iban(text, held, pat):
    return scored(kept(spans_of(text, V.IBAN, False, DIGIT), text, held, pat), text, "IBAN", 0.94, "regex_iban")


def valid_name(name: Column) -> Column:
    words = F.split(strip(name), r"(?U)\s+")
    return F.size(words).between(2, 4) & ~F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, V.NOT_NAMES.split())))


def uncovered(first: Column, more: Column, seen_all: bool = True) -> Column:
    """`first`, then those of `more` that no span before them contains; seen_all: among `more` as well."""
    inside = lambda m, s: (s["start"] <= m["start"]) & (m["end"] <= s["end"])
    return F.aggregate(more, first, lambda acc, m: F.when(F.exists(acc, lambda s: inside(m, s)), acc).otherwise(F.concat(acc, F.array(m))))


def person_salutation(text, held, pat) -> Column:
    named = F.transform(spans_of(text, V.SALUTATION, needs=NAMES), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), anchored(text, s["end"], V.NAME, False).alias("name")))
    good = F.filter(named, lambda x: (x["name"] != "") & valid_name(x["name"]) & ~is_protected(text, x["b"], x["b"] + F.length(x["name"]), held, pat))
    return F.array_distinct(F.transform(good, lambda x: span(x["a"], x["b"] + F.length(x["name"]), F.substring(text, x["a"] + 1, x["b"] - x["a"] + F.length(x["name"])))))


def person_role(text, held, pat) -> Column:
    def names(s):
        inner = spans_of(F.substring(text, s["end"] + 1, F.lit(120)), V.NAME, False)
        return F.transform(inner, lambda n: span(s["end"] + n["start"], s["end"] + n["end"], n["text"]))

    found = F.flatten(F.transform(spans_of(text, V.ROLE, needs=NAMES), names))
    return kept(F.filter(found, lambda n: valid_name(n["text"])), text, held, pat)


def person(text, held, pat):
    by_title = person_salutation(text, held, pat)
    titled = scored(by_title, text, "PERSON", 0.98, "salutation_prefix")
    return uncovered(titled, scored(person_role(text, held, pat), text, "PERSON", 0.96, "role_context"))


def company(text, held, pat):
    def first(s):
        inner = F.slice(spans_of(F.substring(text, s["end"] + 1, F.lit(100)), V.LABELLED_COMPANY, False), 1, 1)
        return F.transform(inner, lambda n: span(s["end"] + n["start"], s["end"] + n["end"], n["text"]))

    labelled = kept(F.flatten(F.transform(spans_of(text, V.BUSINESS_LABEL, needs=contains_any(text, FORMS.split())), first)), text, held, pat)
    lead = F.array(*map(F.lit, V.LEADING_WORDS.split()))

    def trimmed(s):
        words = F.split(strip(s["text"]), r"(?U)\s+")
        n = F.size(words)
        drop = F.aggregate(words, F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda a, w: F.struct((a["k"] + F.when(a["on"] & (n - a["k"] > 2) & F.array_contains(lead, F.lower(w)), 1).otherwise(0)).alias("k"), (a["on"] & (n - a["k"] > 2) & F.array_contains(lead, F.lower(w))).alias("on")), lambda a: a["k"])
        cut = F.length(F.call_function("regexp_extract", s["text"], F.concat(F.lit(r"(?U)^(?:\S+\s+){"), drop.cast("string"), F.lit("}")), F.lit(0)))
        return span(s["start"] + cut, s["end"], F.substring(s["text"], cut + 1, F.length(s["text"])))

    def fine(s):
        words = F.transform(F.split(s["text"], r"(?U)\s+"), F.lower)
        return ~F.lower(s["text"]).isin(V.NOT_COMPANIES.split(";")) & (F.size(words) >= 2) & s["text"].rlike(r"(?U)^\p{Lu}") & ~F.arrays_overlap(words, F.array(*map(F.lit, V.STATUTE_WORDS.split())))

    plain = kept(F.filter(F.transform(spans_of(text, V.COMPANY, needs=FIRM), trimmed), fine), text, held, pat)
    return uncovered(scored(labelled, text, "COMPANY", 0.95, "company_context"), scored(plain, text, "COMPANY", 0.9, "regex_suffix"))


def address(text, held, pat):
    block = F.transform(spans_of(text, V.ADDRESS_LABEL, needs=contains_any(text, [":", "-"])), lambda s: F.struct(s["end"].alias("a"), anchored(text, s["end"], V.ADDRESS_BLOCK.replace("|$)", "|(?-m:(?![\\s\\S])))")).alias("t")))
    good = F.transform(F.filter(block, lambda x: F.length(strip(x["t"])) >= 12), lambda x: span(x["a"], x["a"] + F.length(x["t"]), strip(x["t"])))
    plain = spans_of(text, V.ADDRESS, needs=DIGIT)
    return uncovered(scored(kept(good, text, held, pat), text, "ADDRESS", 0.94, "address_label_block"), scored(kept(plain, text, held, pat), text, "ADDRESS", 0.91, "structural_address"))


def dob(text, held, pat):
    dates = F.transform(spans_of(text, V.BIRTH_LABEL, needs=DIGIT), lambda s: F.struct(s["end"].alias("a"), anchored(text, s["end"], V.DATE).alias("t")))
    good = F.transform(F.filter(dates, lambda x: x["t"] != ""), lambda x: span(x["a"], x["a"] + F.length(x["t"]), x["t"]))
    return scored(kept(good, text, held, pat), text, "DOB", 0.98, "context_gated_dob")


def runs_in_java(pattern: str) -> bool:
    """Whether Java reads the pattern as Python does and it matches no empty text, so that it can run as an expression."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # of sets that others read as nested
            if not hasattr(re, "_parser") or re._parser.parse(pattern).getwidth()[0] == 0:  # not public: without it in Python, which is right as well
                return False
        SparkContext._jvm.java.util.regex.Pattern.compile("(?U)" + pattern)
        return True
    except Exception:  # either may refuse what Python's own matcher takes
        return False


def _python_spans(find, needs: str | None = None):
    """An Arrow function from texts to spans; find gives the start and end of each."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        gate = re.compile(needs).search if needs else lambda t: True
        return pd.Series([[{"start": a, "end": b, "text": t[a:b]} for a, b in find(t)] if t and gate(t) else [] for t in texts])

    return run


def _finder(pattern: str):
    def find(text: str):
        return [m.span() for m in regex.compile(pattern).finditer(text)]

    return find


def custom(rule: Custom, text, held, pat):
    """A pattern of the user's. What Java can't run as an expression runs in Arrow batches, empty matches included; a pattern that
    can't be read at all finds nothing."""
    if runs_in_java(rule.pattern):
        found = spans_of(text, rule.pattern, False)
    else:
        try:
            regex.compile(rule.pattern)
        except regex.error:
            return none(MATCHES)
        found = _python_spans(_finder(rule.pattern))(text)
    return scored(kept(found, text, held, pat), text, rule.name, rule.confidence, "custom_user_regex")


def person_ner(find, text, held, pat):
    """Names that a recogniser of the user's finds, for review: find(text) gives the start and end of each."""
    found = _python_spans(find, r"[A-Z][a-z]+\s+[A-Z][a-z]+")(text)
    return scored(kept(F.filter(found, lambda n: valid_name(n["text"])), text, held, pat), text, "PERSON", 0.75, "ner_candidate")


DETECTORS = dict(zip(ORDER, (email, phone, credit_card, ssn, ip_address, pan, upi_id, iban, person, company, address, dob)))


def register_detector(kind: str, detect) -> None:
    """A detector of the user's for a kind of its own, or in place of one here: detect(text, held, pat), all Columns but the pattern,
    gives matches (see `scored`). It runs where the kind is among a Config's categories."""
    if kind not in DETECTORS:
        ORDER.append(kind)
    DETECTORS[kind] = detect


def protected_spans(text: Column, config: Config = Config()) -> Column:
    return spans_of(text, V.protected_pattern(config.packs, config.protected_terms))


@reused
def _findings(rule: str, text: str, pat: str, detect) -> Column:
    t, held = F.col(text), F.col("_held")
    return F.when(blank(t), none(MATCHES)).otherwise(detect(t, held, pat))


def _column(rule: str | Custom, text: str, pat: str, config: Config) -> Column:
    t, held = F.col(text), F.col("_held")
    if isinstance(rule, Custom):
        return F.when(blank(t), none(MATCHES)).otherwise(custom(rule, t, held, pat))
    if rule == "PERSON" and config.person_ner:
        return F.when(blank(t), none(MATCHES)).otherwise(uncovered(_findings(rule, text, pat, DETECTORS[rule]), person_ner(config.person_ner, t, held, pat)))
    return _findings(rule, text, pat, DETECTORS[rule])


def scan(segments: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """segments with `matches`: what all enabled detectors find, in their order; blank and null texts have none.

    Each detector is a column of its own before they are joined, so that no expression is computed twice."""
    pat = V.protected_pattern(config.packs, config.protected_terms)
    t = F.col(text)
    rows = segments.withColumn("_held", F.when(blank(t), none()).otherwise(protected_spans(t, config)))
    rules = [k for k in ORDER if k in config.categories] + list(config.custom)
    names = [f"_m{i}" for i in range(len(rules))]
    rows = rows.withColumns({n: _column(rule, text, pat, config) for n, rule in zip(names, rules)})
    found = F.concat(*names) if names else none(MATCHES)
    found = F.transform(found, lambda m: m.withField("approved", m["confidence"] >= config.threshold))
    return rows.withColumn("matches", found).drop("_held", *names)
