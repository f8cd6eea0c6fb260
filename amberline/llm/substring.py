"""Exact removal of repeated word windows by super-k-mer partitioning (operator 6).

Every window of W words has a minimiser: its word M-mer of least hash. Consecutive
windows that share it travel as one packed string, the super-k-mer, to the
minimiser's bucket. There all windows are sorted, and each is a repeat if an equal one
starts at a lesser (doc_id, start). Equal windows have equal minimisers, so no repeat is
missed. Rows are told apart by doc_id and a hash of the text: rows that share a doc_id
have the same places, and an equal place is not an earlier one.

Each map task first combines what it holds: windows that repeat an earlier one of the
same few MB are decided there and do not travel, so a passage in a third of all
documents reaches its bucket once per few MB, not once per document. What travels is
packed and compressed by bucket. A bucket is read as a stream; its memory grows with
its distinct windows, not with their occurrences.
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

#: Texts of a map task that are combined together, in bytes.
COMBINE = 2 << 20
_PACKS = "bucket int, pack binary"


def _spans(doc: np.ndarray, start: np.ndarray, mark: np.ndarray, size: int) -> list[np.ndarray]:
    """Windows as runs (doc_id, mark, start, words)."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 4
    order = np.lexsort((start, mark, doc))
    doc, start, mark = doc[order], start[order], mark[order]
    brk = np.ones(len(doc), bool)
    brk[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(brk)
    last = np.append(head[1:], len(doc)) - 1
    return [doc[head], mark[head], start[head], start[last] - start[head] + size]


def _judge(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of windows, which of them in that order start later than an equal one, and which stand there already."""
    order = np.lexsort((mark, start, doc, g, h))
    h, g, doc, start, mark = (x[order] for x in (h, g, doc, start, mark))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    later = (doc != doc[lead]) | (start != start[lead])
    again = same.copy()
    again[1:] &= (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (mark[1:] == mark[:-1])
    return order, later, again


def _runs(batches: Iterator[pa.RecordBatch], size: int, m: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs of super-k-mers (doc ids, first words, byte lengths, marks; texts), a bucket each; bucket < 0: spans decided here."""
    for batch in batches:
        ids, marks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "mark"))
        for a, b, data, off in X.slices(batch.column("text"), COMBINE):
            starts, ends, first = X.words(data, off, X.SPACE)
            n = len(starts)
            if n < size:
                continue
            h = X.hash_words(data, starts, ends)
            ok = np.flatnonzero(X.within(first, size, n))
            if not len(ok):
                continue
            row = np.searchsorted(first, ok, "right") - 1
            doc, start, mark = ids[a:b][row], ok - first[row], marks[a:b][row]
            w0 = X.windows(h, size)[ok]
            s = np.sort(w0)
            repeat, stay = (np.zeros(len(ok), bool) for _ in range(2))
            if (s[1:] == s[:-1]).any():  # a second, independent hash must agree as well
                w1 = X.windows(X.hash_words(data, starts, ends, 1), size, 1)[ok]
                order, later, again = _judge(w0, w1, doc, start, mark)
                repeat[order], stay[order] = later, later | again
            # the least m-mer of each window; windows in a row with the same are one super-k-mer
            keys = X.sliding_min(X.windows(h, m, 1), size - m + 1)[ok]
            brk = np.ones(len(ok), bool)
            brk[1:] = (ok[1:] != ok[:-1] + 1) | (row[1:] != row[:-1]) | stay[1:] | stay[:-1] | (keys[1:] != keys[:-1])
            head = np.flatnonzero(brk & ~stay)
            until = np.append(np.flatnonzero(brk), len(ok))
            last = until[np.searchsorted(until, head, "right")]
            bucket = (keys[head] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            head, last, bucket = head[order], last[order], bucket[order]
            begin, low = ok[head], starts[ok[head]]
            count = ends[ok[last - 1] + size - 1] - low
            text = data[X.spread(low, count)].tobytes()
            at = np.concatenate([[0], np.cumsum(count)])
            fields = [doc[head], start[head], count, mark[head]]
            edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            packs = [X.pack([x[i:j] for x in fields], text[at[i] : at[j]]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            own = bucket[edge[:-1]].tolist()
            if repeat.any():
                own.append(-1 - X.mix_int(int(ids[a])) % buckets)
                packs.append(X.pack(_spans(doc[repeat], start[repeat], mark[repeat], size)))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packs, pa.binary())], ["bucket", "pack"])


def _repeats(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Covered spans (doc_id, mark, start, words) from packs in the order of their buckets.

    Of each distinct window of the bucket the earliest occurrence so far is held; of two
    occurrences the later is a repeat. So packs come in any order and memory follows the
    bucket's distinct windows.
    """
    none = [np.zeros(0, x) for x in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    held, fields, texts, waiting, bucket = none, [], [], 0, None
    out: list[list[np.ndarray]] = []

    def settle() -> None:
        nonlocal held, fields, texts, waiting
        if not fields:
            return
        doc, begin, count, mark = (np.concatenate(x) for x in zip(*fields, strict=True))
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = X.words(data, np.concatenate([[0], np.cumsum(count)]), X.SPACE)
        at = np.flatnonzero(X.within(first, size, len(starts)))
        row = np.searchsorted(first, at, "right") - 1
        new = [X.windows(X.hash_words(data, starts, ends, i), size, i)[at] for i in range(2)] + [doc[row], begin[row] + at - first[row], mark[row]]
        both = [np.concatenate(x) for x in zip(held, new, strict=True)]
        order, later, again = _judge(*both)
        first_of = order[~(later | again)]
        held = [x[first_of] for x in both]
        fields, texts, waiting = [], [], 0
        out.append(_spans(*(x[order[later]] for x in both[2:]), size))

    def emit() -> pa.RecordBatch:
        got = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(got, ["doc_id", "mark", "start", "words"])

    for batch in batches:
        for own, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
            if own != bucket:
                settle()
                held, bucket = none, own
            got, text = X.unpack(pack.as_py())
            if own < 0:
                out.append(got)
                continue
            fields.append(got)
            texts.append(text)
            waiting += len(text)
            if waiting >= COMBINE:
                settle()
        if out:
            yield emit()
    settle()
    if out:
        yield emit()


def repeated_words(docs: DataFrame, scratch: Scratch, size: int = 20, m: int = 4) -> DataFrame:
    """Spans (doc_id, mark, start, words) that cover the words of windows which also start earlier.

    Words are runs of bytes other than ASCII white space, unchanged. Earlier means a
    smaller doc_id, or the same document and a smaller start. Spans may overlap.
    Rows need a doc_id; rows without one are ignored, as are null texts. Rows that
    share a doc_id are one document: windows at equal starts of them do not repeat each
    other. A span belongs to the rows of that doc_id and text (``mark`` is its hash).
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    buckets = max(1024, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packs = docs.mapInArrow(partial(_runs, size=size, m=m, buckets=buckets), _PACKS)
    placed = packs.repartition("bucket").sortWithinPartitions("bucket")
    return scratch.save(placed.mapInArrow(partial(_repeats, size=size), "doc_id long, mark long, start long, words long"))


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans_at = np.concatenate([[0], np.cumsum(batch.column("spans").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = batch.column("spans").flatten()
        begin, length = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)) if len(flat) else (np.zeros(0, np.int64),) * 2
        for a, b, data, off in X.slices(batch.column("text")):
            starts, ends, first = X.words(data, off, X.SPACE)
            total = np.diff(first)
            own = slice(spans_at[a], spans_at[b])
            base = first[:-1][np.repeat(np.arange(b - a), np.diff(spans_at[a : b + 1]))] + begin[own]
            gone = X.covered(base, base + length[own], len(starts))
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(first[:-1], len(gone)))
            removed[total == 0] = 0
            kept, digests = [], []
            raw = data.tobytes()
            for r in range(b - a):
                at = np.flatnonzero(~gone[first[r] : first[r + 1]]) + first[r]
                text = b" ".join([raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], pa.array(total), pa.array(removed), pa.array(digests), pa.array([x.decode() for x in kept] if texts else [None] * len(kept), pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def substring_dedup(docs: DataFrame, scratch: Scratch, size: int = 20, m: int = 4, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), one row per row of ``docs``.

    Each word covered by a window of ``size`` words whose word sequence also starts
    earlier is removed (windows are judged on the input). ``kept`` is the text that
    stays, its words joined by single spaces (null unless ``texts``). Null or empty
    texts have no words; documents of fewer than ``size`` words lose none. Of rows that
    share a doc_id none is earlier than another: a row that stands several times stays in
    every copy, and of different texts only windows with a smaller start in one of them
    go from the others.
    """
    spans = repeated_words(docs, scratch, size, m)
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "words")).alias("spans"))
    both = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(spans, ["doc_id", "mark"], "left")
    return both.mapInArrow(partial(_cut, texts=texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
