"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 4).

The symbols are words. Patterns of one length m (windows of the test items) form one
searcher: a table gives, for a block of B words, how far a window that ends in that
block can move on without passing an occurrence; blocks at a pattern's end give no
shift, and a hash of the whole pattern's words picks the bucket of test strings, which are
compared byte by byte. All rows of a batch are searched together, one position a row
and step, so positions that the shifts skip are never looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm import text as X

#: Patterns that are searched for in one pass over the documents, in bytes of item text; more make more passes.
PASS_BYTES = 32 << 20
#: Words of a text between two lanes of the search, and bits of a shift table.
LANE, BITS = 96, 20


def _canonical(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, a space after each, and where each begins (one more at the end)."""
    keep = X.spread(starts, ends - starts + 1)
    out = np.append(data, np.uint8(32))[keep]
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out[at[1:] - 1] = 32
    return out.tobytes(), at


class Searcher:
    """Wu-Manber tables for patterns of exactly m words."""

    def __init__(self, m: int, patterns: dict[bytes, list[int]], hashes: np.ndarray):
        """hashes: the word hashes of the patterns, a row each, in the order of ``patterns``."""
        self.m, self.block = m, min(2, m)
        self.buckets = defaultdict(list)
        b = self.block
        self.shift = np.full(1 << BITS, m - b + 1, np.uint8 if m < 250 else np.int32)
        for j in range(m - b + 1):
            at = self._slot(np.ascontiguousarray(hashes[:, j : j + b]))
            np.minimum.at(self.shift, at, np.array(m - b - j, self.shift.dtype))
        whole = X.windows(hashes.ravel(), m)[::m] if len(hashes) else np.zeros(0, np.uint64)
        for i, text in enumerate(patterns):
            self.buckets[int(whole[i])].append((text, patterns[text]))
        self.suffix = np.sort(whole)

    def _slot(self, rows: np.ndarray) -> np.ndarray:
        h = rows[:, 0]
        for i in range(1, rows.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i]
        return (X.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the windows that no shift rules out and whose hash some pattern has."""
        m, b = self.m, self.block
        counts = np.diff(first)
        rows = np.flatnonzero(counts >= m)
        lanes = -(-(counts[rows] - m + 1) // LANE)
        base = first[rows].repeat(lanes) + LANE * X.spread(np.zeros(len(rows), np.int64), lanes)
        stop = np.minimum(base + LANE, (first[rows + 1] - m + 1).repeat(lanes))
        found, at = [], base
        while len(at):
            tail = at + m - b
            slot = h[tail]
            for i in range(1, b):
                slot = slot * np.uint64(0x9E3779B97F4A7C15) + h[tail + i]
            step = self.shift[(X.mix(slot) >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(at[zero])
                step[zero] = 1
            at = at + step
            going = at < stop
            at, stop = at[going], stop[going]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(at):
            whole = X.windows(h, m)[at]
            near = np.searchsorted(self.suffix, whole)
            near[near == len(self.suffix)] = 0
            at = at[self.suffix[near] == whole]
        return np.sort(at)


def searchers(items: list[tuple[object, str]], size: int) -> list[Searcher]:
    """One searcher for each pattern length among the items' windows."""
    texts = [t for _, t in items]
    data, off = X.rows_of(pa.array(texts, pa.large_string()))
    data = X.LOWER[data]
    starts, ends, first = X.words(data, off, X.ALNUM)
    h = X.hash_words(data, starts, ends)
    raw, at = _canonical(data, starts, ends)
    by: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    rows: dict[int, list[np.ndarray]] = defaultdict(list)
    for i in range(len(items)):
        n = int(first[i + 1] - first[i])
        m = min(n, size)
        for s in range(first[i], first[i + 1] - m + 1) if n else ():
            text = raw[at[s] : at[s + m]]
            if text not in by[m]:
                by[m][text] = []
                rows[m].append(h[s : s + m])
            if not by[m][text] or by[m][text][-1] != i:
                by[m][text].append(i)
    return [Searcher(m, by[m], np.array(rows[m], np.uint64).reshape(-1, m)) for m in sorted(by)]


def _occurrences(column: pa.Array, ids: list, tables: list[Searcher]) -> Iterator[tuple[int, int, np.ndarray, list[list], list[set]]]:
    """(first row, end row, word counts, spans of each row, ids of each row) of the searched texts, slice by slice."""
    for a, b, data, off in X.slices(column):
        data = X.LOWER[data]
        starts, ends, first = X.words(data, off, X.ALNUM)
        h = X.hash_words(data, starts, ends)
        spans: list[list] = [[] for _ in range(b - a)]
        items: list[set] = [set() for _ in range(b - a)]
        raw = None
        for s in tables:
            at = s.candidates(h, first)
            if not len(at):
                continue
            if raw is None:
                raw, place = _canonical(data, starts, ends)
            whole = X.windows(h, s.m)[at].tolist()
            row = (np.searchsorted(first, at, "right") - 1).tolist()
            for i, r, w in zip(at.tolist(), row, whole, strict=True):
                own = raw[place[i] : place[i + s.m]]
                for text, of in s.buckets[w]:
                    if text == own:
                        items[r].update(str(ids[k]) for k in of)
                        begin, last = i - int(first[r]), spans[r]
                        if last and last[-1][0] <= begin <= last[-1][1]:
                            last[-1] = (last[-1][0], max(last[-1][1], begin + s.m))
                        else:
                            last.append((begin, begin + s.m))
                        break
        yield a, b, np.diff(first), spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch], shared, first_pass: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not first_pass:
            before, named = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        for a, b, counts, spans, items in _occurrences(batch.column("text"), *shared.value):
            spans = [[{"start": x, "end": y} for x, y in r] for r in spans]
            if not first_pass:
                spans = [x + y for x, y in zip(before[a:b], spans, strict=True)]
                items = [{*x, *y} for x, y in zip(named[a:b], items, strict=True)]
            out = [batch.column("doc_id")[a:b], batch.column("text")[a:b], pa.array(counts), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text", "n_words", "spans", "items"])


def _clean(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for a, b, _, spans, _ in _occurrences(batch.column("text"), *shared.value):
            keep[a:b] = [not x for x in spans]
        yield batch.filter(pa.array(keep))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, shas = [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            hit, reach = 0, 0
            for s, e in sorted((x["start"], x["end"]) for x in spans):
                hit += max(0, e - max(s, reach))
                reach = max(reach, e)
            hits.append(hit)
            shas.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in batch.column("items").to_pylist()], pa.int64()), pa.array(shas), pa.array([x > 0 for x in hits]), batch.column("spans"), batch.column("items")],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
        )


def item_blocks(benchmark: DataFrame, most: int = PASS_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items (item_id, text) in blocks of at most about ``most`` bytes, streamed from the cluster."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


_SEARCHED = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items), one row per row of ``docs``.

    Words are runs of ASCII letters and digits, lower-cased, and all other characters
    from U+0080. A window is ``size`` consecutive words of an item; an item of fewer
    words, but some, is one window. ``n_hit`` counts the document's words inside
    occurrences of windows, ``spans`` holds those (words, half-open), ``items`` the ids
    with occurring windows as sorted strings. Null or empty texts have no words and no hits;
    an empty benchmark hits nothing; a null text or item without words has no windows.

    The benchmark is the stated query set: it goes to the executors in blocks of
    ``pass_bytes`` and each block searches all documents, so its size is bounded per
    pass and no item is left out.
    """
    cur, first = docs.select("doc_id", "text"), True
    for shared in _passes(benchmark, size, pass_bytes):
        cur = cur.mapInArrow(partial(_search, shared=shared, first_pass=first), _SEARCHED)
        first = False
    return cur.drop("text").mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, items array<string>")


def _passes(benchmark: DataFrame, size: int, pass_bytes: int) -> Iterator:
    """For each block of items, its searchers on the executors; one empty pass if there is no item."""
    sc = benchmark.sparkSession.sparkContext
    none = True
    for block in item_blocks(benchmark, pass_bytes):
        none = False
        yield sc.broadcast(([i for i, _ in block], searchers(block, size)))
    if none:
        yield sc.broadcast(([], []))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of the benchmark."""
    for shared in _passes(benchmark, size, pass_bytes):
        docs = docs.mapInArrow(partial(_clean, shared=shared), docs.schema)
    return docs
