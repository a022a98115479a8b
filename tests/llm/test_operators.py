"""The operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from redactory.llm import decontaminate, line_dedup, lm_score, media, ngram_join, packing, substring_dedup, token_files, toxicity, warc
from redactory.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, n long, rep long, keys string"


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = prose(60)
    out = [prose(r.choice([1, 3, 30, 80, 200])) for _ in range(20)]
    base = prose(120)
    out += [base, base, base.replace("w1 ", "x1 ", 1), f"{prose(10)} {shared} {prose(5)}", f"{shared}\n{prose(70)}", shared.upper()]
    out += [f"{prose(8)}\n{prose(9)}\n{prose(7)}\n{prose(6)}"]
    out += [out[-1] + "\n" + prose(4), out[-1], None, "", " \n\t", "a", "a", "é ü\x0b x", "z" * 5000 + " " + prose(3000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, empty):
    sets = {}
    for i, t in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    expected = {i: (len(s), find(i)) for i, s in sets.items()}
    assert {r[0]: (r[1], r[2]) for r in ngram_join.ngram_join(docs).collect()} == expected
    # with blocks far below their usual size, so that they are split
    assert {r[0]: (r[1], r[2]) for r in ngram_join.ngram_join(docs, block_shingles=40).collect()} == expected
    assert ngram_join.ngram_join(empty).count() == 0


def test_divide_skip_equals_all_pairs():
    r = random.Random(3)
    for _ in range(30):
        base = [np.array(sorted(r.sample(range(60), r.randint(1, 25))), np.uint64) for _ in range(6)]
        sets = [np.array(sorted({*r.choice(base).tolist()} ^ {*r.sample(range(60), r.randint(0, 3))} or {1}), np.uint64) for _ in range(25)]
        up = list(range(25))

        def find(x):
            return x if up[x] == x else find(up[x])

        for i in range(25):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 75 * len(a | b):
                    x, y = sorted((find(i), find(j)))
                    up[y] = x
        assert ngram_join.divide_skip(sets, 75, 100) == [find(i) for i in range(25)]


def test_substring_dedup(docs, empty):
    first, expected = {}, {}
    for i, t in corpus():
        w = (t or "").encode().split()
        keep, mine = [True] * len(w), []
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            mine.append(k)
            if first.get(k, i) < i:
                keep[p : p + 50] = [False] * 50
        for k in mine:
            first.setdefault(k, i)
        expected[i] = (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in substring_dedup.substring_dedup(docs).collect()} == expected
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_negative_ids(spark, docs):
    low = docs.withColumn("doc_id", docs["doc_id"] - 100)
    for op, ids in ((ngram_join.ngram_join, (0, 2)), (substring_dedup.substring_dedup, (0,))):
        rows = [tuple(x) for x in op(docs).collect()]
        expected = {tuple(v - 100 if k in ids else v for k, v in enumerate(x)) for x in rows}
        assert {tuple(x) for x in op(low).collect()} == expected


def test_line_dedup(docs, empty):
    seen, expected = set(), {}
    for i, t in corpus():
        lines = (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for p in range(len(full) - 2):
            run = tuple(lines[k] for k in full[p : p + 3])
            if run in seen:
                gone.update(full[p : p + 3])
            seen.add(run)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        expected[i] = (len(full), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert any(n for _, n, _ in expected.values())
    assert {r[0]: tuple(r[1:]) for r in line_dedup.line_dedup(docs).collect()} == expected
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_of_few_long_lines(spark):
    import corpus_pipeline

    r = random.Random(7)
    prose = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(n))
    long, edge, one, two, short = prose(51), prose(50), prose(30), prose(21), prose(6)
    texts = [long, edge, f"{one}\n \n{two}", f"{short}\n{long}\n{prose(3)}", edge, f"{prose(4)}\n{one}\n{two}\n{short}", f"{two}\n{one}", long, f"{long}\n\n{long}\n{short}", None, ""]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        full, gone = [k for k, x in enumerate(lines) if x.strip()], set()
        for p in range(len(full)):
            for n in (1, 2, 3):
                run = tuple(lines[k] for k in full[p : p + n])
                if len(run) == n and (n == 3 or sum(len(x.split()) for x in run) > 50):
                    if run in seen:
                        gone.update(full[p : p + n])
                    seen.add(run)
        expected[i] = (len(full), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    assert [expected[i][1] for i in range(11)] == [0, 0, 0, 1, 0, 2, 0, 1, 2, 0, 0]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {x[0]: (x[1], x[2], x[3]) for x in line_dedup.line_dedup(docs, words=50).collect()}
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in expected.items()}
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert {x["doc_id"]: (x["text"] or "", x["n_chars"]) for x in kept} == {i: (t, len(t)) for i, (n, m, t) in expected.items() if not m or m < n}


def test_decontaminate(spark, docs, empty):
    texts = [t for _, t in corpus()]
    items = [(1, " ".join(texts[5].split()[:30]) + " q"), (2, "one two three four five six"), (3, None), (4, "too short"), (5, texts[24])]
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long")
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(len(w) - 4)}
    expected = set()
    for i, t in corpus():
        for k, x in items:
            n, both = len(shingles(x)), len(shingles(x) & shingles(t))
            if n and both * 100 >= n * 75:
                expected.add((i, k, n, both))
    got = decontaminate.contained(docs, bench).collect()
    assert expected and {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got} == expected
    assert decontaminate.contained(empty, bench).count() == 0


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return [np.array(x.ids + [1], np.uint32) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_and_packing(docs, empty):
    rows = corpus()
    ids, start, expected, pieces = ids_of([t for _, t in rows]), 0, {}, {}
    for (i, _), x in zip(rows, ids):
        expected[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
        for k in range(0, len(x), 100):
            pieces[i, k // 100] = (k, len(x[k : k + 100]), zlib.crc32(x[k : k + 100].tobytes()))
    files = token_files.write_files(docs, file_ids=1000)
    assert {r[0]: tuple(r[1:]) for r in token_files.read_files(files).collect()} == expected
    one = token_files.TokenFile(files.first()["content"])
    assert (one.document(len(one.doc_ids) - 1) == ids[int(one.doc_ids[-1])]).all()
    got = packing.pack(docs, length=100, node_items=20).collect()
    assert {(r[0], r[1]): tuple(r[2:5]) for r in got} == pieces
    for seq in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 100
    assert token_files.read_files(token_files.write_files(empty)).count() == 0 and packing.pack(empty).count() == 0


def test_pfor_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 9), (255, 2), (256, 1), (1000, 49408), (5000, 2**32)):
        x = r.integers(0, top, n).astype(np.uint32)
        x[::37] = top - 1
        f = token_files.TokenFile(token_files.write_file(np.array([7]), np.array([n]), x))
        assert (f.ids() == x).all() and (f.ids(n // 3, n // 2) == x[n // 3 : n // 2]).all()


def test_words_with_odd_parts(spark):
    texts = ["don't we'LL stop.now, ÉTÉ ǰ J̌ İ", "<|endoftext|> a<|startoftext|>b ok.", "x!!! 12.5, ... ;a", "　wide space", "é ́x", "ΑΣ ς"]
    got = token_files.TokenFile(token_files.write_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).coalesce(1).first()["content"])
    files = token_files.write_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {}
    for f in files:
        g = token_files.TokenFile(f["content"])
        found |= {int(d): g.document(k).tolist() for k, d in enumerate(g.doc_ids)}
    assert got.n_ids and found == {i: x.tolist() for i, x in enumerate(ids_of(texts))}


def test_media(docs, empty):
    got = {r["doc_id"]: r for r in media.read(media.store(docs)).collect()}
    for i, t in corpus():
        data = (t or "").encode()
        payload = media.padded(data)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert "continuity_errors=0" in got[i]["feature"] and len(got[i]["pts"]) == len(payload) // 576
    stream = media.mux(b"x" * 576 * 130)
    assert media.demux(stream).payload == b"x" * 576 * 130 and len(media.demux(stream).random_access) == 3
    assert media.demux(stream[: 188 * 5] + stream[188 * 6 :]).continuity_errors > 0
    assert media.read(media.store(empty)).count() == 0


def test_warc(spark):
    big = "y" * 1500
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c", "small"), (4, "u\r\nv", "small"), (5, "", None), (6, "http://f", big + "!"), (7, "http://g", big)]
    got = {r["page_id"]: r for r in warc.archive_pages(spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, payload string")).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 7, 2: 7, 3: None, 4: None, 5: None, 6: None, 7: None}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_toxicity(spark, empty):
    from pyspark.sql import functions as F

    r = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" Vile!" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    w = toxicity.fit(docs, labels, F.col("doc_id") < 200)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, w).collect()}
    assert len(got) == 402 and all(0 <= x <= 1 for x in got.values())
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows[200:])
    assert toxicity.clean(docs, w).count() == 302
    assert toxicity.score(empty, toxicity.fit(docs, labels, F.lit(False))).count() == 0


def test_lm_score(docs, empty):
    import math

    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in corpus()}
    held = lm_score.crc_fold(5, 1)
    counts = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.score(docs, held).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0
    assert lm_score.score(empty, held).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    prose = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    item = prose(20)
    texts = [prose(50) + (" vile" if i % 3 == 0 else "") for i in range(90)]
    texts += [texts[1], texts[2].replace(" ", "  "), prose(5) + " " + item + " " + prose(5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({x["doc_id"] for x in out.collect()}) == [i for i in range(90) if i % 3]
