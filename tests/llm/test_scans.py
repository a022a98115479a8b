"""Periodic runs, licence scans and ranked search against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pytest

from redactory.llm import licences, ranked, runs

SCHEMA = "doc_id long, text string, n long, start long, score double, runs string"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 0.5, "k") for i, t in texts], SCHEMA).repartition(3)


def _runs(w, least=6, times=4):
    """Brute force: for each period the stretches that keep it, of one stretch the least period."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_periodic_runs(spark, empty):
    r = random.Random(5)
    some = lambda k, n: [r.choice("abcdef"[:k]) for _ in range(n)]
    made = [some(2, 70), some(1, 40), some(3, 3) * 9 + some(2, 5), (some(2, 3) * 5 + some(3, 4)) * 6, some(1, 5), some(1, 6), (["x", "y"] * 9 + ["z"]) * 4, some(6, 300)]
    texts = list(enumerate([" ".join(w) for w in made] + [None, "", " \n\t", "a", "é é é é é é\x0bé", "A a " * 8, "w" * 3000 + " w" * 3000]))
    texts += [(0, texts[0][1]), (None, "a a a a a a"), *((i, " ".join(some(6, 60))) for i in range(100, 140))]
    got = {}
    for row in runs.periodic_runs(table(spark, texts), reread=runs.replayed, part=200).collect():
        got.setdefault(row.doc_id, []).append(row)
    assert sorted(got) == sorted({i for i, _ in texts if i is not None}) and len(got[0]) == 2
    for key, text in texts:
        if key is None:
            continue
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(key).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = _runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        for row in got[key]:
            assert [tuple(x) for x in row.runs] == found and row.n_runs == len(found)
            assert (row.start, row.length, row.period) == (best or (None,) * 3)
            assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
            assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
            assert row.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert any(runs.replayed(i, 60) is not None for i in range(100, 140))
    three = {row.doc_id: [tuple(x) for x in row.runs] for row in runs.periodic_runs(table(spark, texts[:8]), 3, 3).collect()}
    assert three == {i: _runs(t.split(), 3, 3) for i, t in texts[:8]}
    assert runs.periodic_runs(empty).count() == 0


def _matches(w, t, least):
    """Brute force: all stretches of equal words that neither side extends."""
    out = []
    for x in range(len(w)):
        for y in range(len(t)):
            if w[x] == t[y] and not (x and y and w[x - 1] == t[y - 1]):
                n = 0
                while x + n < len(w) and y + n < len(t) and w[x + n] == t[y + n]:
                    n += 1
                if n >= least:
                    out.append((x, y, n))
    return sorted(out)


def _scanned(text, templates, phrases, match, gap, share):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    w = split(text)
    found = [(label, i) for label, p in phrases for i in range(len(w)) if w[i : i + len(split(p))] == split(p)]
    chains, most = [], 0.0
    for label, t in templates:
        t = split(t)
        own, best = _matches(w, t, match), {}
        for m in own:
            x, y, n = m
            ways = [(n, -x)]
            for u, v, k in own:
                shared = max(0, u + k - x, v + k - y)
                if u < x and v < y and x - u - k <= gap and y - v - k <= gap and shared < n:
                    ways.append((best[(u, v, k)][0] + n - shared, best[(u, v, k)][1]))
            best[m] = max(ways)
            most = max(most, best[m][0] / len(t))
            if best[m][0] >= share * len(t):
                chains.append((-best[m][0], -best[m][0] / len(t), -best[m][1], x + n, label))
    spans = []
    for _, part, a, b, label in sorted(chains):
        if all(b <= c or d <= a for _, c, d, _ in spans):
            spans.append((label, a, b, -part))
    base = sorted({x for x, _ in found})
    places = [i for _, i in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *(x[0] for x in spans)})), 1.0 if found else most, sorted(spans, key=lambda x: x[1])


def test_licence_scan(spark, empty):
    r = random.Random(8)
    whole = dict(licences.TEMPLATES)
    noise = lambda n: " ".join(r.choice(["the", "license", "and", "by", "software", "w1", "w2", "public"]) for _ in range(n))
    holed = lambda t, k: " ".join(x for i, x in enumerate(t.split()) if i % k)
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "ALL RIGHTS\nRESERVED, all rights reserved all rights", "cc-by cc_by CC by\u00e9", "general public licenses", None, "", " \n", "a"]
    texts += [f"{noise(9)} {whole[k]} {noise(5)}" for k in ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "isc")]
    texts += [holed(whole["mit"], 11), holed(whole["bsd-3-clause"], 7), whole["mit"][:200] + noise(20) + whole["mit"][200:], (whole["zlib"] + "\n") * 3, *(noise(60) for _ in range(6))]
    texts = [*enumerate(texts), (0, texts[0]), (None, "all rights reserved")]
    few = [("x", "a b a b c"), ("y", "b a b"), ("y", "c c c c"), ("z", "a b a b")]
    small = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for i in range(60)]
    for rows, args in ((texts, (licences.TEMPLATES, licences.PHRASES, 3, 8, 0.75)), (small, (few, [("p", "c"), ("q", "a b")], 2, 1, 0.6)), (small, (few, [], 1, 3, 1.0))):
        got = licences.licence_scan(table(spark, rows), *args).collect()
        assert len(got) == sum(i is not None for i, _ in rows)
        for row in got:
            *told, spans = tuple(row)[1:]
            assert (*told, [tuple(x) for x in spans]) == _scanned(dict(rows)[row.doc_id], *args), row.doc_id
    by = {row.doc_id: row.labels for row in licences.licence_scan(table(spark, texts)).collect()}
    assert [by[i] for i in range(6)] == ["mit", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "reserved", "cc-by", ""]
    assert [by[i] for i in range(10, 16)] == ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl,gpl-2.0", "isc"]
    assert licences.licence_scan(empty).count() == 0
    with pytest.raises(ValueError):
        licences.licence_scan(empty, [("x", "...")])


def _ranked(docs, items, k):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    texts = [(i, w) for i, t in docs if i is not None and (w := split(t))]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        terms = [t for _, text in sorted({(i, x or "") for i, x in items if i == item}) for t in split(text)]
        scores = []
        for i, w in texts:
            m = 75 + 25 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms if t in w)
            if score:
                scores.append((-score, i))
        out += [(item, rank, i, -x) for rank, (x, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranked_search(spark, empty, monkeypatch):
    r = random.Random(11)
    words = [f"w{i}" for i in range(90)] + ["The", "the", "THE", "\u00e9t\u00e9", "x9"]
    prose = lambda n: " ".join(r.choice(words[: r.choice([9, 95])]) + r.choice(["", ",", "-"]) for _ in range(n))
    docs = [(i, prose(r.choice([1, 5, 40, 300]))) for i in range(150)]
    docs += [(i + 1000, docs[i][1]) for i in range(0, 60, 2)] + [(5, docs[5][1]), (7, "another w3 w4"), (None, "w1 w2"), (2000, None), (2001, ""), (2002, "..."), (2003, "the " * 4000)]
    items = [(i, prose(r.choice([1, 6, 30]))) for i in range(30)] + [(3, "w1 w1 w80"), (4, None), (40, "absent"), (41, ""), (42, None), (None, "w1"), (0, docs[0][1]), (0, docs[0][1])]
    queries = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in items], "item_id long, text string, doc_id long, rank long, block string")
    for args in ((20, 64, 4), (3, 2, 1)):
        assert sorted(map(tuple, ranked.ranked_search(table(spark, docs), queries, *args).collect())) == _ranked(docs, items, args[0])
    monkeypatch.setattr(ranked, "GROUP_TERMS", 100)
    assert sorted(map(tuple, ranked.ranked_search(table(spark, docs), queries).collect())) == _ranked(docs, items, 20)
    assert ranked.ranked_search(empty, queries).count() == 0
    assert ranked.ranked_search(table(spark, docs), queries.limit(0)).count() == 0


def test_ranked_search_leaves_blocks_unread(spark, monkeypatch):
    """A query whose terms stand in a few documents scores the blocks of these alone."""
    docs = [(i, f"common words here {i}" + (" rare" * 3 if i % 500 == 0 else "")) for i in range(3000)]
    index = ranked.build(table(spark, docs), stats := ranked.totals(table(spark, docs)), 16)
    q = ranked.Queries(*map(ranked.np.asarray, zip(*((0, int(t)) for t in ranked._terms(ranked.pa.array(["common rare"]))[0]))))
    q.weigh(ranked._frequencies(index, q), stats[0])
    bounds = [q.bounds(ranked.np.frombuffer(x.terms, "<i8"), ranked.np.frombuffer(x.tops, "<i4"))[0] for x in index.collect()]
    found = ranked.search(index, stats, spark.createDataFrame([(0, "common rare")], "item_id long, text string"), 6).collect()
    assert {x.doc_id for x in found} == {0, 500, 1000, 1500, 2000, 2500}
    assert 0 < sum(b >= found[-1].score for b in bounds) <= 6 < len(bounds) / 20
