"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures (operator 8).

A document's signature has 32 positions of 16 bits, dealt into 8 chunks of 4. Two
signatures that differ in at most 15 positions differ in at most one position of some
chunk (pigeonhole), so listing every chunk with each one of its positions masked (the
allowed chunk error) meets *every* pair within that distance. At a similarity of 0.8 a
position differs with probability 0.2, so a pair lies beyond 15 of 32 with probability
under 2e-4, and far less above 0.8. Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm import text as X
from amberline.llm.buckets import lanes_differ, link_buckets
from amberline.llm.scratch import Scratch

CHUNKS, LANES, DISTANCE = 8, 4, 15
_rng = np.random.default_rng(8)
_MULTIPLY = _rng.integers(1, 2**62, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, CHUNKS * LANES, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row of lower-cased bytes, and where each row's begin.

    A row with fewer words, but some, has its whole word sequence as one shingle.
    """
    starts, ends, first = X.words(data, off, X.SPACE)
    h = X.hash_words(data, starts, ends)
    counts = np.diff(first)
    grams = X.windows(h, n)
    grams = grams[X.within(first, n, len(h))] if len(grams) else grams
    sizes = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        at = np.concatenate([[0], np.cumsum(sizes)])[short]
        whole = np.array([int(X.windows(h[first[i] : first[i + 1]], int(counts[i]))[0]) ^ int(counts[i]) for i in short], np.uint64)
        grams = np.insert(grams, at, whole)
        sizes[short] = 1
    return grams, np.concatenate([[0], np.cumsum(sizes)])


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in X.slices(batch.column("text")):
            grams, at = shingles(X.LOWER[data], off, n)
            rows = b - a
            some = np.flatnonzero(np.diff(at))
            lanes = np.zeros((CHUNKS * LANES, rows), np.uint64)
            if len(some):
                for i, (m, c) in enumerate(zip(_MULTIPLY, _ADD, strict=True)):
                    lanes[i, some] = X.mix(np.minimum.reduceat(grams * m + c, at[some])) & np.uint64(0xFFFF)
            chunks = np.zeros((rows, CHUNKS), np.uint64)
            for i in range(CHUNKS * LANES):
                chunks[:, i // LANES] |= lanes[i] << np.uint64(16 * (i % LANES))
            size, digest = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
            for r in some:
                u = np.unique(grams[at[r] : at[r + 1]])
                size[r] = len(u)
                digest[r] = X.windows(u, len(u))[0], X.windows(X.mix(u), len(u), 1)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[a:b],
                    pa.array(size),
                    pa.array(digest[:, 0].view(np.int64)),
                    pa.array(digest[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, rows * CHUNKS + 1, CHUNKS, dtype=np.int32)), pa.array(chunks.ravel().view(np.int64))),
                ],
                ["doc_id", "n", "d1", "d2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in X.slices(batch.column("text")):
            grams, at = shingles(X.LOWER[data], off, n)
            each = [np.unique(grams[at[r] : at[r + 1]]) for r in range(b - a)]
            ends = np.concatenate([[0], np.cumsum([len(u) for u in each])]).astype(np.int32)
            values = np.concatenate(each).view(np.int64) if each else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("sig")[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["v", "sig", "x"])


def _keys(sig: str, chunks: range) -> Column:
    keys = []
    for c in chunks:
        for lane in range(LANES):
            mask = ((1 << 64) - 1) ^ (0xFFFF << (16 * lane))
            mask -= (1 << 64) if mask >= 1 << 63 else 0
            keys.append(F.xxhash64(F.lit(c * LANES + lane), F.col(sig)[c].bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Texts are lower-cased (A-Z) and split on ASCII white space; a document's set holds
    its distinct ``words``-word shingles, or its whole sequence if it has fewer words.
    Documents link when 100 * intersection >= percent * union; ``component_id`` is the
    smallest doc_id that links reach.

    Equal sets are one class, linked through a hash of the whole set, so copies cost
    one row each; ``link_buckets`` holds classes that share a bucket against each other.

    Null and empty texts have no shingles, link with nothing and are kept. Rows that
    share a doc_id count as one document. A null doc_id links with nothing (component
    null, kept true). Other columns are ignored.
    """
    docs, inner = docs.select("doc_id", "text"), Scratch(docs.sparkSession, "minhash")
    sig = inner.save(docs.mapInArrow(partial(_signatures, n=words), "doc_id long, n long, d1 long, d2 long, sig array<long>"))
    real = sig.where("n > 0 and doc_id is not null")
    classes = inner.save(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig")))
    keyed = [classes.select(F.explode(_keys("sig", range(c, c + 2))).alias("key"), F.col("rep").alias("v")) for c in range(0, CHUNKS, 2)]

    def close(a: str, b: str) -> Column:
        return sum((lanes_differ(F.col(a)[i], F.col(b)[i], 16) for i in range(1, CHUNKS)), lanes_differ(F.col(a)[0], F.col(b)[0], 16)) <= DISTANCE

    def nodes_of(wanted: DataFrame) -> DataFrame:
        own = docs.join(classes.select(F.col("rep").alias("doc_id"), "sig").join(wanted.withColumnRenamed("v", "doc_id"), "doc_id"), "doc_id")
        return own.mapInArrow(partial(_sets, n=words), "v long, sig array<long>, x array<long>")

    comp = link_buckets(keyed, nodes_of, lambda x: x, close, percent, inner)

    # a document stands for all its rows, and so joins the classes of all of them
    rows = sig.join(classes.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    rows = rows.withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    out = rows.join(comp.withColumnRenamed("v", "rep"), "rep", "left")
    cid = F.coalesce("component", "rep")
    out = scratch.save(out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept")))
    inner.clear()
    return out
