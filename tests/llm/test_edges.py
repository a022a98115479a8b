"""Repeated and missing ids, clashing columns, the steps of the methods by themselves, and models against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactory.llm import decontaminate, line_dedup, lm_score, media, ngram_join, packing, substring_dedup, token_files, toxicity
from redactory.llm._common import components, sized, stored

SCHEMA = "doc_id long, text string, score double, label int, sig string, bin string, node long"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "s", "b", 7) for i, t in rows], SCHEMA).repartition(3)


A, B, C = prose(90, 1), prose(90, 2), prose(60, 3)
#: One id with two texts, of which each has a copy elsewhere; one with the same text twice; no id; null text.
REPEATED = [(1, A), (1, B), (2, A), (3, B), (4, C), (4, C), (None, A), (5, None)]


def test_join_links_by_any_text_of_an_id(spark):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.ngram_join(table(spark, REPEATED)).collect()}
    size = lambda t: len({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    assert got == {1: (max(size(A), size(B)), 1), 2: (size(A), 1), 3: (size(B), 1), 4: (size(C), 4), 5: (0, 5)}


def test_substring_of_repeated_ids(spark):
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(table(spark, REPEATED)).collect())
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 90, 0, whole(A)), (1, 90, 0, whole(B)), (2, 90, 90, whole("")), (3, 90, 90, whole("")), (4, 60, 0, whole(C)), (5, 0, 0, whole(""))])


def test_levels_double_to_the_window():
    assert substring_dedup.levels(50) == [7, 13, 25, 50]
    for w in range(2, 90):
        x = substring_dedup.levels(w)
        assert x[-1] == w and x[0] <= 7 and all(a < b <= 2 * a for a, b in zip(x, x[1:]))


def test_each_level_carries_its_survivors_alone(spark, monkeypatch):
    """Of documents that share 10, 20, 40 and 60 words the first two pairs leave before the level of 25 words, the third before that of 50."""
    texts = []
    for k, n in enumerate((10, 20, 40, 60)):
        shared = prose(n, 100 + k)
        texts += [f"{prose(70, 200 + k)} {shared} {prose(70, 300 + k)}", f"{prose(70, 400 + k)} {shared} {prose(70, 500 + k)}"]
    seen = {}
    plain = substring_dedup.stored

    def spy(df, name, **options):
        out = plain(df, name, **options)
        if name == "substring-live":
            seen[len(seen)] = sorted(r[0] for r in out.select("doc_id").collect())
        return out

    monkeypatch.setattr(substring_dedup, "stored", spy)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, enumerate(texts))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 60}
    assert len(seen) == 3 and {6, 7} <= set(seen[2]) <= set(seen[1]) <= set(seen[0]) and set(seen[2]) <= {4, 5, 6, 7}


def test_lines_extend_both_ways_and_others_of_a_fingerprint_are_found(spark):
    """A common line among other neighbours: what its first place doesn't match, a later one does."""
    line = lambda k: prose(6, k)
    common = line(0)
    one = [line(1), line(2), common, line(3), line(4)]
    two = [line(5), line(6), common, line(7), line(8)]
    texts = ["\n".join(x) for x in (one, two, [line(9), *one, line(10)], [line(11), *two[1:], line(12)], [common, common, line(13)])]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            run = tuple(lines[p : p + 3])
            gone |= set(range(p, p + 3)) if run in seen else set()
            seen.add(run)
        expected[i] = len(gone)
    assert expected == {0: 0, 1: 0, 2: 5, 3: 4, 4: 0}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(table(spark, enumerate(texts))).collect()} == expected
    runs = {r["doc_id"]: sorted(tuple(x) for x in r["runs"]) for r in line_dedup.later_runs(table(spark, enumerate(texts))).collect()}
    assert (1, 5) in runs[2]  # one match, extended to the passage's ends


def test_long_lists_are_probed_and_hits_counted(monkeypatch):
    r = random.Random(9)
    base = sorted(r.sample(range(10**6), 120))
    sets = [np.array(sorted({*r.sample(base, 110), *r.sample(range(10**6), 8)}), np.uint64) for _ in range(40)]
    found = ngram_join.divide_skip(sets, 75, 100)
    lengths = np.array([40] * 110 + [1] * 8)
    assert 0 < ngram_join.longest_lists(lengths, 89) < 89
    for skipped in (0, 1, 88):
        monkeypatch.setattr(ngram_join, "longest_lists", lambda lengths, t, k=skipped: min(k, t - 1))
        assert ngram_join.divide_skip(sets, 75, 100) == found
    assert len(set(found)) < 40


def test_components_of_chains_hubs_and_pairs(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(300, 340)] + [(k, 7) for k in range(400, 460)] + [(459, 3), (500, 501), (3, 3)]
    r.shuffle(edges)
    got = {x[0]: x[1] for x in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{k: 300 for k in range(300, 341)}, **{k: 3 for k in [3, 7, *range(400, 460)]}, 500: 500, 501: 500}


def test_broadcasts_go_by_bytes(spark):
    small = stored(spark.range(5).select("id", F.repeat(F.lit("x"), 100).alias("t")), "test")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(sized(small)) and not hinted(sized(small, F.octet_length("t") * 1_000_000))


def test_items_of_all_size_classes(spark):
    sizes = [5, 6, 9, 16, 17, 40, 70, 150]
    items = [(k, prose(n, 700 + k)) for k, n in enumerate(sizes)]
    docs, expected = [], set()
    for k, (i, t) in enumerate(items):
        w = t.split()
        docs.append((2 * k, f"{prose(400, 800 + k)} {t} {prose(400, 900 + k)}"))
        docs.append((2 * k + 1, f"{prose(400, 1000 + k)} {' '.join(w[: len(w) // 2])} {prose(400, 1100 + k)}"))
        expected.add((2 * k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(table(spark, docs + [(0, "x"), (None, items[0][1])]), bench).collect()} == expected


def test_token_files_and_packing_of_repeated_ids(spark):
    rows = REPEATED + [(9, prose(40, 50)) for _ in range(60)]
    read = lambda: sorted(tuple(r) for r in token_files.read_files(token_files.write_files(table(spark, rows), file_ids=500)).collect())
    first = read()
    assert first == read() and len(first) == len(rows) - 1
    order = sorted(first, key=lambda r: r[1])
    assert [r[0] for r in order] == sorted(r[0] for r in first) and all(a[1] + a[2] == b[1] for a, b in zip(order, order[1:]))
    got = packing.pack(table(spark, rows), length=100, node_items=10, slack=0).collect()
    assert Counter(r["doc_id"] for r in got)[9] >= 60
    bins = Counter()
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 100


def test_packing_is_near_the_least_number(spark):
    """No cap: many underfull bins of many nodes meet again until few merge."""
    r = random.Random(6)
    docs = table(spark, [(i, prose(r.choice([3, 10, 25, 30, 45]), i)) for i in range(600)])
    got = packing.pack(docs, length=100, node_items=40, slack=2).collect()
    bins = Counter()
    for x in got:
        bins[x["sequence_id"]] += x["length"]
    least = -(-sum(bins.values()) // 100)
    assert len(bins) <= 1.06 * least + 2


def test_toxicity_equals_plain_ftrl(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(12)) + (" bad" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    docs = table(spark, [(i, t) for i, t, _ in rows] + [(1, "a repeated row bad"), (None, "no id bad")])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string")
    learn = F.col("doc_id") >= 2
    at, w = toxicity.fit(docs, labels, learn, bits=16, epochs=2)

    import pyarrow as pa

    def found(t):
        return sorted({int(x) for _, _, f, _ in toxicity.features(pa.array([t]), 16) for x in f})

    order = sorted((i for i, _, _ in rows if i >= 2), key=lambda i: (int(toxicity.mix(np.array([i], np.int64).view(np.uint64))[0]), i))
    z, n = Counter(), Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= 10 else (math.copysign(10, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) / 0.6)
    for _ in range(2):
        for i in order:
            keys = [*found(rows[i][1]), "bias"]
            held = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(held.values()))) - rows[i][2]
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.6 * held[k]
                n[k] += g * g
    assert dict(zip(at[:-1].tolist(), w[:-1])) == pytest.approx({k: weight(k) for k in z if k != "bias" and weight(k)})
    assert w[-1] == pytest.approx(weight("bias"))
    got = [tuple(x) for x in toxicity.score(docs, (at, w), bits=16).collect()]
    assert len(got) == 62 and {i for i, _ in got} == {*range(60), None}
    assert toxicity.clean(docs, (at, w), bits=16).columns == docs.columns


def test_lm_score_equals_plain_interpolation(spark):
    r = random.Random(8)
    texts = {i: " ".join(r.choice("abcdefghij") for _ in range(r.randrange(0, 40))) for i in range(80)}
    texts[80], texts[81] = None, texts[3]
    held = lm_score.crc_fold(5, 1)
    tokens = {i: [*(t or "").split(), "END"] for i, t in texts.items()}
    one, two, three = Counter(), Counter(), Counter()
    for i, ws in tokens.items():
        if not held(i):
            padded = ["END", *ws]
            one.update(ws), two.update(zip(padded, ws)), three.update(zip(padded, ws, ws[1:]))
    n, v = sum(one.values()), len(one)

    def estimates(ws, k, off):
        before = ws[k - 1] if k else "END"
        c1, u, c2 = one[ws[k]] - off, one[before] - off, two[before, ws[k]] - off
        pair = ((ws[k - 2] if k > 1 else "END"), before) if k else None
        u2, c3 = (max(two[pair] - off, 0), max(three[(*pair, ws[k])] - off, 0)) if k else (0, 0)
        bucket = lambda c: min(int(math.log2(c)) + 1, lm_score.CLASSES - 1) if c > 0 else 0
        return lm_score.CLASSES + bucket(u2) if u2 > 0 else bucket(u), (c3 / max(u2, 1), c2 / max(u, 1), c1 / max(n - off, 1))

    exact = Counter(estimates(ws, k, 1) for i, ws in tokens.items() if not held(i) for k in range(len(ws)))

    def em(histogram):
        w = {}
        for b in {b for b, _ in histogram}:
            x = [0.3, 0.3, 0.3, 0.1]
            x = [0.0 if k == 0 and b < lm_score.CLASSES or k == 1 and b == 0 else y for k, y in enumerate(x)]
            x = [y / sum(x) for y in x]
            least = [1e-3 * (y > 0) for y in x]
            for _ in range(60):
                sums = list(least)
                for (c, p), m in histogram.items():
                    if c == b:
                        post = [a * y for a, y in zip((*p, 1 / (v + 1)), x)]
                        sums = [s + m * y / max(sum(post), 1e-300) for s, y in zip(sums, post)]
                x = [s / sum(sums) for s in sums]
            w[b] = x
        return w

    step = lambda p: 0.0 if p <= 0 else 2 ** (-float(min(np.round(-lm_score.FINE * np.log2(p)), lm_score.STEPS - 2)) / lm_score.FINE)
    coarse = Counter()
    for (b, p), m in exact.items():
        coarse[b, tuple(step(x) for x in p)] += m
    weights, fine = em(coarse), em(exact)
    start = lambda b: [0.0, 0.0, 0.75, 0.25] if b == 0 else [0.0, 3 / 7, 3 / 7, 1 / 7] if b < lm_score.CLASSES else [0.3, 0.3, 0.3, 0.1]

    def total(ws, w):
        out = 0.0
        for k in range(len(ws)):
            b, p = estimates(ws, k, 0)
            out += math.log10(sum(a * y for a, y in zip((*p, 1 / (v + 1)), w.get(b) or start(b))))
        return out

    got = {r["doc_id"]: r["score"] for r in lm_score.score(table(spark, texts.items()), held).collect()}
    unseen = [i for i in got if any(estimates(tokens[i], k, 0)[0] not in weights for k in range(len(tokens[i])))]
    assert len(unseen) < 20
    for i, s in got.items():
        if i not in unseen:
            assert s == pytest.approx(total(tokens[i], weights), rel=1e-6)
    # estimates in half octaves cost the fit less than a hundredth
    known = [i for i in got if i not in unseen]
    assert abs(sum(total(tokens[i], weights) for i in known) / sum(total(tokens[i], fine) for i in known) - 1) < 0.01


def test_counts_beyond_a_byte_travel_whole():
    x = np.array([0, 1, 254, 255, 256, 2**33, 7])
    assert (lm_score.unpacked(lm_score.packed(x), len(x)) == x).all()


def test_streams_of_others():
    stream = media.mux(bytes(range(256)) * 9)
    plain, size = media.demux(stream), media.PACKET
    packets = [stream[k : k + size] for k in range(0, len(stream), size)]
    k = next(k for k in range(3, len(packets)) if packets[k][1] & 0x1F == media.DATA_PID >> 8 and packets[k][2] == media.DATA_PID & 255 and packets[k][3] & 0x10)
    twice = media.demux(b"".join([*packets[: k + 1], packets[k], *packets[k + 1 :]]))
    assert (twice.payload, twice.continuity_errors) == (plain.payload, 0)
    assert media.demux(b"".join(packets[:k] + packets[k + 1 :])).continuity_errors == 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _id long"
    rows = [(i, prose(40, i) + (" vile" if i % 3 == 0 else ""), "en", None, 9, 0.1, 1) for i in range(60)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s", 0, 0.0, 0), (None, prose(30, 77), "en", "s", 1, 0.0, 0), (1, rows[1][1], "en", None, 9, 0.1, 1)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, prose(20, 5000)), (1, None)], "item_id long, text string")
    for name, docs, ids in (("full", rows, {i for i in range(60) if i % 3} | {100, 101}), ("none", [], set())):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, f"{tmp_path}/{name}"), "test")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert {r[0] for r in docs.collect()} - {None} == ids
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()} == ids


def test_checksums_of_ids(spark):
    got = token_files.read_files(token_files.write_files(table(spark, [(3, None), (4, "")]))).collect()
    assert {r["ids_crc32"] for r in got} == {zlib.crc32(np.array([1], "<u4").tobytes())}


def test_line_dedup_stage_with_columns_of_its_own_names(spark):
    import corpus_pipeline

    rows = [(0, "a b\nc d\ne f\ng", 7, 1, "x"), (1, "h\na b\nc d\ne f", 8, 2, "y"), (2, "a b\nc d\ne f", 9, 3, None), (3, None, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _n_removed long, __N_LINES string")
    got = sorted(corpus_pipeline.drop_repeated_lines(spark, docs, "").collect())
    assert [tuple(r) for r in got] == [rows[0], (1, "h", 1, 2, "y"), rows[3]]
