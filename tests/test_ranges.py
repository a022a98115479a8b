"""Files read in ranges of a few bytes against the readers of whole files."""

import csv
import io
import random

import pytest

from redactory.sources import ranges, readers


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Ranges of so many bytes, but for the tables that are written and read back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, kept = {k: spark.conf.get(k) for k in names}, ranges.kept

    def back():
        for k, v in before.items():
            spark.conf.set(k, v)

    def first_written(df, name):
        out = kept(df, name)
        back()
        return out

    monkeypatch.setattr(ranges, "kept", first_written)
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(names, (str(n), "0"))]
    back()


def write(folder, files):
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return str(folder)


def expected(files):
    return sorted((name, s, t, tuple(sorted(m.items()))) for name, content in files.items() for s, t, m in readers.segments_of(name, content))


def got(rows):
    return sorted((r.doc_id.rpartition("/")[2], r.segment_id, r.text, tuple(sorted(r.meta.items()))) for r in rows.collect())


def test_lines(spark, tmp_path, small_ranges):
    r = random.Random(1)
    line = lambda: "".join(r.choice(["a", "bc ", "é", "\r", "\x0b", "\x1c", " ", " ", "x" * 9]) for _ in range(r.randint(0, 9)))
    texts = ["\n".join(line() for _ in range(12)), "\r\n".join(line() for _ in range(12)) + "\r\n", "one", "one\n", "\n", "\n\n", "", "﻿mark\nb", "﻿mark\nb\n", "no end\x0b", "\r", "a\r\n\r\n"]
    files = {f"f{i}.txt": t.encode() for i, t in enumerate(texts)} | {"g.log": b"bad \xff\xfe bytes\nnext\n", "skip.bin": b"no\n"}
    path = write(tmp_path / "in", files)
    for n in (37, 1 << 20):
        small_ranges(n)
        assert got(ranges.read_lines(spark, path)) == expected({k: v for k, v in files.items() if k != "skip.bin"})


def test_cells(spark, tmp_path, small_ranges):
    r = random.Random(3)
    cell = lambda: "".join(r.choice(["a", '"', ",", "\n", "\r\n", " ", "é", "tab\t", "word"]) for _ in range(r.randint(0, 6)))

    def table(rows, mark=",", end="\r\n"):
        out = io.StringIO(newline="")
        csv.writer(out, delimiter=mark, lineterminator=end).writerows(rows)
        return out.getvalue().encode()

    files = {f"t{i}.csv": table([[cell() for _ in range(r.randint(0, 4))] for _ in range(9)], end=r.choice(["\n", "\r\n"])) for i in range(4)}
    files |= {"u.tsv": table([[cell() for _ in range(3)] for _ in range(9)], "\t"), "open.csv": b'a,b\n1,"never closed\nx,y', "stray.csv": b'a"b,c\n"d"e"f,g\nh,"i\n"" j",k\n\n,\n"",x\n', "bare.csv": b'a,b\rc,"d\re"\rf\ng\r\nh,"i\nj"\rk,"l\nm",n\n', "one.csv": b"a,b", "none.csv": b""}
    path = write(tmp_path / "in", files)
    for n in (53, 1 << 20):
        small_ranges(n)
        cells = ranges.read_cells(spark, path)
        assert got(cells) == expected(files)
    order = {}
    for x in cells.orderBy("doc_id", "seg_ord").collect():
        order.setdefault(x.doc_id, []).append((int(x.meta["row"]), int(x.meta["col"])))
    assert all(v == sorted(v) for v in order.values())


def test_large_files_of_a_folder_are_read_in_ranges(spark, tmp_path, small_ranges, monkeypatch):
    files = {"a.txt": b"one\ntwo\n" * 30, "b.txt": b"small\n", "c.csv": b'1,"x\ny"\n' * 60, "d.csv": b"z,\n"}
    path = write(tmp_path / "in", files)
    monkeypatch.setattr(ranges, "LARGE", 100)
    small_ranges(50)
    assert got(readers.read_documents(spark, path)) == expected(files)
