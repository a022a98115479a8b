"""Periodic runs of words: every maximal stretch with a smallest period that is repeated several times.

The runs theorem: of each run one Lyndon root, under one of the two orders of the alphabet, is the longest Lyndon word that
starts at its place. So, for the words of a document as symbols:

1. a suffix array by prefix doubling (only suffixes that are not yet told apart are sorted again), and its inverse;
2. the longest Lyndon word from each place on ends before the next smaller value of the inverse suffix array, for the other
   order before the next greater one; both are looked up in a tree of minima;
3. the root is extended to the right by the common prefix of the suffixes at its start and at its end, and to the left by
   that of the reversed text: least value of a range of the LCP array, from a sparse table over blocks of it.

A run of e periods holds a root that e - 2 whole periods follow, so roots that are followed by less are dropped at once; only documents that have any get an LCP array and a suffix array of the reversed text. LCPs are
compared at irreducible places alone (the sum of these is O(n log n)), the others follow. Memory is a few arrays as long as
the words of a part: texts are taken in parts of about `part` bytes, a longer text is a part of its own. Documents are dealt
out by nothing but the input's partitions: there is no shuffle.

Words are [^\\x20\\x09-\\x0D]+, unchanged, told apart by 64 bits of hash. Null and empty texts have no words and no runs. Rows
without an id are dropped; repeated rows keep a row each. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import lean, parts, spans, text_buffer, word_hashes

#: Length of the blocks whose minima the sparse table holds.
_CELL = 32


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse. symbols: sorted by row first, so that suffixes of a row are apart from the others'.

    ends: for each place the end of its row; a suffix that is the beginning of another is smaller."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    at, h = np.flatnonzero(~(new & np.append(new[1:], True))), 1
    while len(at):
        suffix = order[at]
        then = suffix + h
        inside = then < ends[suffix]
        key = rank[suffix] * (n + 1)
        key[inside] += rank[then[inside]] + 1
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffix] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return order, rank


def next_smaller(a: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length: near ones one by one, the others by a tree of minima."""
    n, top = len(a), np.iinfo(np.int64).max
    levels = [a]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append(np.minimum(x[::2], np.append(x[1::2], top) if len(x) % 2 else x[1::2]))
    out, who = np.full(n, n, np.int64), np.arange(n)
    for d in range(1, 6):
        who = who[: np.searchsorted(who, n - d)]
        hit = a[who + d] < a[who]
        out[who[hit]] = who[hit] + d
        who = who[~hit]
    node = who
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for x in levels[:-1]:
        beside = node + 1
        hit = (node % 2 == 0) & (beside < len(x))
        hit[hit] = x[beside[hit]] < a[who[hit]]
        found.append((who[hit], beside[hit]))
        who, node = who[~hit], node[~hit] >> 1
    who, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x, (mine, at) in zip(reversed(levels[:-1]), reversed(found)):
        node = node * 2  # from a node of the level above to its first child with a smaller value
        node = node + (x[node] >= a[who])
        who, node = np.concatenate((who, mine)), np.concatenate((node, at))
    out[who] = node
    return out


def lcp_array(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the suffix array; 0 for the first of a row."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)  # by place: the suffix before it, of the same row
    before[order[1:]] = order[:-1]
    same = before >= 0
    same[same] = ends[before[same]] == ends[same]
    follows = np.zeros(n, bool)  # its value is that of the place to the left, less one
    here = np.flatnonzero(same[1:]) + 1
    b = before[here]
    ok = (b > 0) & (ends[here - 1] == ends[here])
    ok[ok] = (ends[b[ok] - 1] == ends[b[ok]]) & (symbols[b[ok] - 1] == symbols[here[ok] - 1])
    follows[here[ok]] = True
    own = np.flatnonzero(~follows & same)
    value = np.zeros(n, np.int64)
    a, b, k = own, before[own], 0
    while len(a):
        if k == 16:  # the few long ones by slices
            for x, y in zip(a.tolist(), b.tolist()):
                value[x] = k + _common(symbols, x + k, y + k, int(ends[x]))
            break
        ok = (a + k < ends[a]) & (b + k < ends[a])
        ok[ok] = symbols[a[ok] + k] == symbols[b[ok] + k]
        value[a[~ok]] = k
        a, b = a[ok], b[ok]
        k += 1
    at = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    value = value[at] - (np.arange(n) - at)
    value[~same] = 0
    return value[order]


def _common(symbols: np.ndarray, x: int, y: int, end: int, step: int = 64) -> int:
    most, done = end - max(x, y), 0
    while done < most:
        size = min(step, most - done)
        differ = symbols[x + done : x + done + size] != symbols[y + done : y + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + size, min(step * 4, 1 << 16)
    return most


class RangeMin:
    """Least value of ranges: a sparse table over the minima of blocks, and minima from a block's start and to its end."""

    def __init__(self, a: np.ndarray):
        n = -(-max(1, len(a)) // _CELL) * _CELL
        cells = np.full(n, np.iinfo(np.int64).max, np.int64)
        cells[: len(a)] = a
        cells = cells.reshape(-1, _CELL)
        self.flat = cells.ravel()
        self.head = np.minimum.accumulate(cells, axis=1).ravel()
        self.tail = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [cells.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(cells):
            x, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(x[:-half], x[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the values lo..hi, both included."""
        a, b = lo // _CELL, hi // _CELL
        out = np.minimum(self.tail[lo], self.head[hi])
        power = np.frexp(np.maximum(b - a - 1, 0))[1]  # of the blocks between
        for i in np.unique(power).tolist():
            if i:
                x = np.flatnonzero(power == i)
                t = self.table[i - 1]
                out[x] = np.minimum(out[x], np.minimum(t[a[x] + 1], t[b[x] - (1 << (i - 1))]))
        one = np.flatnonzero(a == b)
        if len(one):
            at = lo[one].copy()
            out[one] = self.flat[at]
            while len(one):
                out[one] = np.minimum(out[one], self.flat[at])
                at += 1
                more = at <= hi[one]
                one, at = one[more], at[more]
        return out


class _Prefixes:
    """Common prefixes of two suffixes of one row."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, ranked: tuple[np.ndarray, np.ndarray] | None = None):
        order, self.rank = ranked or suffix_ranks(symbols, ends)
        self.least = RangeMin(lcp_array(symbols, ends, order, self.rank)).least

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[x], self.rank[y]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def word_runs(words: np.ndarray, rows: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of the runs, by row, start and period; places count from the start of all rows."""
    n, none, after = len(words), (np.zeros(0, np.int64),) * 4, least_exponent - 2
    if not n:
        return none
    size = np.diff(rows)
    row = np.repeat(np.arange(len(size)), size)
    ends = np.repeat(rows[1:], size)
    kinds, symbols = np.unique(words, return_inverse=True)
    symbols = symbols.reshape(-1).astype(np.int64) + row * len(kinds)
    order, rank = suffix_ranks(symbols, ends)
    roots = []
    for a in (rank - rows[row], rows[row] - rank):  # both orders; what follows a row counts as smaller than the row
        at = np.arange(n)
        stop = np.minimum(next_smaller(a - 2 * n * row), ends)
        period = stop - at
        ok = np.flatnonzero(stop + after * period <= ends)
        for k in range(min(3, after + 1)):  # most places end here
            ok = ok[symbols[at[ok] + k] == symbols[np.minimum(stop[ok] + k, n - 1)]]
        roots.append((ok, period[ok]))
    start, period = (np.concatenate(x) for x in zip(*roots))
    if not len(start):
        return none
    live = np.unique(row[start])  # only these rows go on
    keep = np.isin(row, live)
    new = np.cumsum(keep) - 1
    sizes = size[live]
    begins = np.cumsum(sizes) - sizes
    first, last = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    x = symbols[keep]
    kept = order[np.isin(row[order], live)]
    place = np.empty(len(kept), np.int64)
    place[new[kept]] = np.arange(len(kept))
    ahead = _Prefixes(x, last, (new[kept], place))
    i = new[start]
    right = ahead(i, i + period)
    ok = right >= after * period
    i, period, right = i[ok], period[ok], right[ok]
    if not len(i):
        return none
    # the reversed rows: place j of a row becomes first + last - 1 - j
    mirror = first + last - 1 - np.arange(len(x))
    behind = _Prefixes(x[mirror], last)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > first[i])
    left[inner] = behind(mirror[i[inner] - 1], mirror[i[inner] + period[inner] - 1])
    begin, length = i - left, left + right + period
    ok = length >= np.maximum(least_length, least_exponent * period)
    begin, length, period = begin[ok], length[ok], period[ok]
    by = np.lexsort((period, length, begin))
    begin, length, period = begin[by], length[by], period[by]
    new_run = np.ones(len(begin), bool)  # of one stretch the least period; several roots find one run
    new_run[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, period = begin[new_run], length[new_run], period[new_run]
    which = np.searchsorted(begins, begin, side="right") - 1
    by = np.lexsort((period, begin))
    which, begin, length, period = which[by], begin[by], length[by], period[by]
    return live[which], begin - begins[which] + rows[live[which]], length, period


def replayed(doc_id: int, n: int) -> np.ndarray | None:
    """Of each tenth document (by crc32 of the id) the order of words in which its end repeats its first words; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _digest(data: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """sha256 of the words with a space between them, some thousand at a time."""
    out = hashlib.sha256()
    for i in range(0, len(starts), 1 << 15):
        if i:
            out.update(b" ")
        out.update(b" ".join([data[a:b] for a, b in zip(starts[i : i + (1 << 15)].tolist(), ends[i : i + (1 << 15)].tolist())]))
    return out.hexdigest()


_RUNS = "array<struct<start: long, length: long, period: long>>"
_SCHEMA = f"doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs {_RUNS}"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))])


def _described(batch: pa.RecordBatch, least_length: int, least_exponent: int, reread: Callable[[int, int], np.ndarray | None] | None) -> pa.RecordBatch:
    ids = batch.column(0).to_pylist()
    buf, offs = text_buffer(batch.column(1))
    starts, ends, rows = spans(buf, offs)
    words, data = word_hashes(buf, starts, ends), buf.tobytes()
    edges = rows.tolist()
    if reread:
        for key, a, b in zip(ids, edges[:-1], edges[1:]):
            if (then := reread(key, b - a)) is not None:
                words[a:b], starts[a:b], ends[a:b] = words[a:b][then], starts[a:b][then], ends[a:b][then]
    row, begin, length, period = word_runs(words, rows, least_length, least_exponent)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, begin + period, 1)
    np.subtract.at(gone, begin + length, 1)
    kept = np.cumsum(gone[:-1]) == 0
    cut = np.searchsorted(row, np.arange(len(ids) + 1))
    out = []
    for i, (key, a, b) in enumerate(zip(ids, edges[:-1], edges[1:])):
        own = slice(cut[i], cut[i + 1])
        found = list(zip((begin[own] - a).tolist(), length[own].tolist(), period[own].tolist()))
        best = min(((-n, s, p) for s, n, p in found), default=None)
        one = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        told = hashlib.sha256()
        for k in range(0, len(found), 1 << 12):
            told.update("".join(f"{s},{n},{p}\n" for s, n, p in found[k : k + (1 << 12)]).encode())
        here = slice(a, b) if not found else a + np.flatnonzero(kept[a:b])
        out.append((key, len(found), *one, told.hexdigest(), _digest(data, starts[here], ends[here]), [{"start": s, "length": n, "period": p} for s, n, p in found]))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def periodic_runs(documents: DataFrame, least_length: int = 6, least_exponent: int = 4, reread: Callable[[int, int], np.ndarray | None] | None = None, part: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its runs, the longest of them, and digests of all runs and of the text without repeats.

    A run has at least `least_length` words and `least_exponent` periods (3 or more); `collapsed_sha256` is of the words but those that any run holds
    after its first period, joined by one space. reread: gives for an id and a number of words the places in whose order the
    words are read instead, or None. Of runs as long as each other the first is reported, then that with the least period;
    a document without runs has nulls there."""
    if least_exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return docs.mapInArrow(lean(lambda batches: (_described(p, least_length, least_exponent, reread) for b in batches for p in parts(b, size=part))), _SCHEMA)
