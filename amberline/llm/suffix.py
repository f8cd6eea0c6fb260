"""Removal of byte strings that other documents hold, by minimiser partitions and exact comparison (operator 9).

Both suffix arrays of the dealt method, of the dictionary and of the parse, are replaced:
only windows of one fixed length W are asked for, so it is enough that equal windows meet.

Parsing. A rolling hash runs over every text; in each window of W bytes the least hash
of its K-byte strings is the trigger, and consecutive windows with one trigger are a
phrase (with its W - 1 bytes of overlap). Which phrase a window belongs to depends on
the window's own bytes alone, so equal windows lie in phrases of equal triggers.

Dictionary. Phrases that are equal as a whole are one entry. Of an entry, every
occurrence outside its first document is removed entirely, without looking inside; in
highly repetitive text that is nearly all of it. Only first occurrences whose trigger
other entries share are compared further.

Comparison. Those entries travel with their bytes to their trigger's bucket. Within
slices of 256 KB the windows are sorted in byte order and equal neighbours are equal
windows; across slices a dictionary of the windows' bytes decides. Nothing is sorted
over the whole dictionary, and no corpus order is combined from a parse: the first
document of a window is that of least doc_id. A trigger is one group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm import text as X
from amberline.llm.scratch import Scratch

#: Bytes of text that a map task combines together, and phrases of a bucket that are settled together.
COMBINE, SETTLE = 2 << 20, 500_000
_PACKS = "bucket int, pack binary"


def _prefix(data: np.ndarray, which: int) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(X._TABLES[which][data] * X.powers(X._BASES[which], len(data)), out=total[1:])
    return total


def _span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    h = (total[ends] - total[starts]) * X.powers(X._BASES[which], len(total), True)[starts]
    return X.mix(h + (ends - starts).astype(np.uint64))


def _parse(batches: Iterator[pa.RecordBatch], size: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs of phrases (trigger and number of windows, entry, doc id, start, mark), a bucket of triggers each.

    Bucket < 0: runs (doc id, start, mark, windows) that are known to repeat a smaller document's.
    """
    for batch in batches:
        ids, marks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "mark"))
        for a, b, data, off in X.slices(batch.column("text"), COMBINE):
            if len(data) < size:
                continue
            total = _prefix(data, 0)
            grams = X.mix((total[k:] - total[:-k]) * X.powers(X._BASES[0], len(total), True)[: len(data) - k + 1])
            low = X.sliding_min(grams, size - k + 1)
            del grams
            brk = np.ones(len(low), bool)
            brk[1:] = low[1:] != low[:-1]
            brk[off[off < len(low)]] = True
            # windows that reach into the next row are no windows
            last = off[1:] - size
            good = last >= off[:-1]
            begin = np.flatnonzero(brk)
            row = np.searchsorted(off, begin, "right") - 1
            end = np.minimum(np.append(begin[1:], len(low)), last[row] + 1)
            keep = good[row] & (end > begin)
            begin, end, row = begin[keep], end[keep], row[keep]
            if not len(begin):
                continue
            trigger, doc = low[begin], ids[a:b][row]
            entry = _span_hash(_prefix(data, 1), begin, end + size - 1, 1)
            order = np.lexsort((begin, doc, entry, trigger))
            new = np.ones(len(begin), bool)
            new[1:] = (trigger[order][1:] != trigger[order][:-1]) | (entry[order][1:] != entry[order][:-1])
            lead = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(begin)), 0))]
            known = np.zeros(len(begin), bool)
            known[order] = doc[order] > lead
            # neighbours that are known make one span
            head = np.ones(len(begin), bool)
            head[1:] = ~(known[1:] & known[:-1] & (row[1:] == row[:-1]) & (begin[1:] == end[:-1]))
            at = np.flatnonzero(head)
            until = end[np.append(at[1:], len(begin)) - 1]
            n, known, trigger, entry, doc = until - begin[at], known[at], trigger[at], entry[at], doc[at]
            start, mark = begin[at] - off[row[at]], marks[a:b][row[at]]
            own, packs = [], []
            if known.any():
                own.append(-1 - X.mix_int(int(ids[a])) % buckets)
                packs.append(X.pack([x[known] for x in (doc, start, mark, n)]))
            bucket = (trigger % np.uint64(buckets)).astype(np.int64)
            bucket[known] = -1
            order = np.argsort(bucket, kind="stable")[np.count_nonzero(known) :]
            fields = [((trigger >> np.uint64(32) << np.uint64(32)) | n.astype(np.uint64)).view(np.int64)[order], entry.view(np.int64)[order], doc[order], start[order], mark[order]]
            bucket = bucket[order]
            if len(bucket):
                edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                packs += [X.pack([x[i:j] for x in fields]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                own += bucket[edge[:-1]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packs, pa.binary())], ["bucket", "pack"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known repeats (n < 0) and phrases to compare (n > 0) from packs in the order of their buckets.

    Of each entry only the occurrences in its first document so far are held, so packs
    come in any order and memory follows the bucket's dictionary.
    """
    none = [np.zeros(0, np.int64)] * 5
    held, waiting, rows, bucket = none, [], 0, None
    out: list[tuple[np.ndarray, ...]] = []

    def settle() -> None:
        nonlocal held, waiting, rows
        t, e, d, s, m = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
        order = np.lexsort((m, s, d, e, t))
        t, e, d, s, m = (x[order] for x in (t, e, d, s, m))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (e[1:] != e[:-1])
        later = d > d[np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))]
        out.append((t[later], d[later], m[later], s[later], -(t[later] & 0xFFFFFFFF)))
        more = new | later  # phrases of a row that stands several times are held once
        more[1:] |= (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (m[1:] != m[:-1])
        held, waiting, rows = [x[more & ~later] for x in (t, e, d, s, m)], [], 0

    def finish() -> None:
        """What is held is in the order of (trigger, entry); triggers of several entries and documents are to be compared."""
        nonlocal held
        if waiting:
            settle()
        t, e, d, s, m = held
        if len(t):
            key = t >> 32
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(t))))
            kinds = np.bincount(group[1:], (t[1:] != t[:-1]) | (e[1:] != e[:-1]), len(heads)) - np.append(0, np.ones(len(heads) - 1))
            many = ((kinds > 0) & (np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)))[group]
            out.append((key[many], d[many], m[many], s[many], t[many] & 0xFFFFFFFF))
        held = none

    def emit() -> pa.RecordBatch:
        got = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(got, ["trigger", "doc_id", "mark", "start", "n"])

    for batch in batches:
        for own, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
            if own != bucket:
                finish()
                bucket = own
            got, _ = X.unpack(pack.as_py())
            if own < 0:
                doc, start, mark, n = got
                out.append((doc, doc, mark, start, -n))
                continue
            waiting.append(got)
            rows += len(got[0])
            if rows >= SETTLE:
                settle()
        if out:
            yield emit()
    finish()
    if out:
        yield emit()


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    lists = batch.column("spans")
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = lists.flatten()
    return at, [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


def _bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the entries to compare."""
    for batch in batches:
        ids, marks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "mark"))
        at, (start, n, trigger) = _spans(batch)
        for a, b, data, off in X.slices(batch.column("text")):
            own = slice(at[a], at[b])
            row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
            count = n[own] + size - 1
            packed = data[X.spread(off[row] + start[own], count)]
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(trigger[own]), pa.array(ids[a:b][row]), pa.array(marks[a:b][row]), pa.array(start[own]), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])],
                ["trigger", "doc_id", "mark", "start", "packed"],
            )


def _order(data: np.ndarray, at: np.ndarray, size: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that begin at ``at``, in the order of (first, bytes, at), and which equal the one before."""
    padded = np.append(data, np.zeros(8, np.uint8))
    columns = []
    for i in [*range(0, size - 8, 8), size - 8] if size >= 8 else [0]:
        word = np.zeros(len(at), np.uint64)
        for j in range(min(8, size)):
            word = (word << np.uint64(8)) | padded[at + i + j].astype(np.uint64)
        columns.append(word)
    order = np.lexsort((*columns[::-1], first))
    same = np.zeros(len(at), bool)
    same[1:] = first[order][1:] == first[order][:-1]
    for c in columns:
        same[1:] &= c[order][1:] == c[order][:-1]
    return order, same


def _compare(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows (doc_id, mark, start, n) from entries in the order of (trigger, doc_id, start)."""
    open_t, seen = None, {}
    for batch in batches:
        trigger, doc, mark, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        out = [(doc[:0], mark[:0], start[:0], start[:0])]
        for a, b, data, off in X.slices(batch.column("packed"), 256 << 10):
            n = np.diff(off) - size + 1
            row = np.repeat(np.arange(b - a), n)
            at = X.spread(off[:-1], n)
            t, d = trigger[a:b][row], doc[a:b][row]
            order, same = _order(data, at, size, t)
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
            hit = np.zeros(len(at), bool)
            hit[order] = d[order] > d[order][lead]
            raw = data.tobytes()
            for i in np.flatnonzero((t == open_t) & ~hit) if seen else ():
                hit[i] = seen.get(raw[at[i] : at[i] + size], d[i]) < d[i]
            if (last := trigger[b - 1]) != open_t:
                open_t, seen = last, {}
            for i in order[~same][t[order[~same]] == last]:
                seen.setdefault(raw[at[i] : at[i] + size], d[i])
            got = np.flatnonzero(hit)
            if len(got):
                brk = np.ones(len(got), bool)
                brk[1:] = (got[1:] != got[:-1] + 1) | (row[got][1:] != row[got][:-1])
                head = np.flatnonzero(brk)
                r = row[got[head]]
                out.append((doc[a:b][r], mark[a:b][r], start[a:b][r] + at[got[head]] - off[r], np.diff(np.append(head, len(got)))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["doc_id", "mark", "start", "n"])


def repeated_bytes(docs: DataFrame, scratch: Scratch, size: int = 50, k: int = 16) -> DataFrame:
    """Runs (doc_id, mark, start, n) of n windows of ``size`` bytes that also start in a document of smaller doc_id.

    A run belongs to the rows of that doc_id and text (``mark`` is its hash).
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    buckets = max(1024, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packs = docs.mapInArrow(partial(_parse, size=size, k=k, buckets=buckets), _PACKS)
    placed = packs.repartition("bucket").sortWithinPartitions("bucket")
    found = scratch.save(placed.mapInArrow(_entries, "trigger long, doc_id long, mark long, start long, n long"))
    wanted = found.where("n > 0").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "n", "trigger")).alias("spans"))
    packed = docs.join(wanted, ["doc_id", "mark"]).mapInArrow(partial(_bytes, size=size), "trigger long, doc_id long, mark long, start long, packed binary")
    placed = packed.repartition("trigger").sortWithinPartitions("trigger", "doc_id", "start")
    more = scratch.save(placed.mapInArrow(partial(_compare, size=size), "doc_id long, mark long, start long, n long"))
    return found.where("n < 0").select("doc_id", "mark", "start", (-F.col("n")).alias("n")).unionAll(more)


def _cut(batches: Iterator[pa.RecordBatch], size: int, kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, fields = _spans(batch)
        start, n = fields[:2]
        for a, b, data, off in X.slices(batch.column("text")):
            own = slice(at[a], at[b])
            base = np.repeat(off[:-1], np.diff(at[a : b + 1])) + start[own]
            gone = X.covered(base, base + n[own] + size - 1, len(data))
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            begins = gone.copy()
            begins[1:] &= ~gone[:-1] | edge[1:-1]
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
            rest = data[~gone].tobytes()
            cut = np.concatenate([[0], np.cumsum(~gone)])[off]
            each = [rest[cut[r] : cut[r + 1]] for r in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], pa.array(np.diff(off)), pa.array(count(gone)), pa.array(count(begins)), pa.array([hashlib.sha256(x).hexdigest() for x in each]), pa.array(each if kept else [None] * len(each), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def suffix_dedup(docs: DataFrame, scratch: Scratch, size: int = 50, k: int = 16, kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row of ``docs``.

    Each UTF-8 byte covered by a ``size``-byte string that also starts in a document of
    smaller doc_id is removed; overlaps count, and strings are judged on the input.
    ``kept`` holds the bytes that stay (null unless ``kept``); a cut may fall inside a
    character, hence bytes. Null texts are empty; texts shorter than ``size`` and rows
    without doc_id lose nothing. Rows that share a doc_id count as one document: they
    never repeat each other, and each loses what its own text repeats of other documents.
    """
    runs = repeated_bytes(docs, scratch, size, k)
    spans = runs.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    both = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(spans, ["doc_id", "mark"], "left")
    return both.mapInArrow(partial(_cut, size=size, kept=kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
