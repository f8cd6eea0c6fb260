"""Embedding near-dedup by Euclidean p-stable hashing (operator 1).

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance
threshold. A table hashes a vector to the cells floor((a . v + b) / w) of k Gaussian
projections; tables are as many as a pair at the threshold itself is missed by all with
probability ``MISS`` at most. k grows with the logarithm of the number of vectors, so
that a bucket holds about ``BACKGROUND`` unrelated ones at every size. Within a bucket
cosines are exact, in double precision. A pair counts in the first table in which it
meets; cells are computed in integers, so that every task agrees which one that is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm import text as X
from amberline.llm.components import components
from amberline.llm.scratch import Scratch

WIDTH, MISS, BACKGROUND = 2.0, 1e-3, 64
#: Larger buckets are split into blocks of about half as many vectors, and pairs of blocks go to tasks of their own.
HOT = 2048
#: Hot buckets that are looked up from a broadcast at most; more are joined.
BROADCAST_KEYS = 100_000
_VECTOR_BITS, _LINE_BITS = 24, 12


def meets(distance: float, width: float = WIDTH) -> float:
    """The probability that two vectors at ``distance`` share a cell of one projection."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = meets(math.sqrt(2 - 2 * threshold)), meets(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 1) / BACKGROUND) / -math.log(far))) if n > BACKGROUND else 1
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


@cache
def _lines(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, k, tables])
    a = np.rint(rng.standard_normal((dim, tables * k)) * 2**_LINE_BITS)
    return a, np.rint(rng.random(tables * k) * WIDTH * 2 ** (_VECTOR_BITS + _LINE_BITS))


def cells(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 64-bit bucket key for each vector and table. All sums are of integers below 2**53, so exact in any order."""
    a, b = _lines(unit.shape[1], k, tables)
    at = np.rint(unit * 2**_VECTOR_BITS) @ a + b
    at = np.floor(at / (WIDTH * 2 ** (_VECTOR_BITS + _LINE_BITS))).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    h = np.broadcast_to(X.mix(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 32)), at.shape[:2]).copy()
    for i in range(k):
        h = X.mix(h * np.uint64(0x9E3779B97F4A7C15) + at[:, :, i])
    return h.view(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; null where one cannot link."""
    for batch in batches:
        column = batch.column("embedding")
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        out = []
        for i, known in enumerate(batch.column("vec_id").is_valid().to_pylist()):
            v = flat[at[i] : at[i + 1]]
            out.append(v.tobytes() if known and len(v) and np.isfinite(v).all() and np.any(v) else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])


def _units(column: pa.Array, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) of each dimension."""
    data, off = X.rows_of(column)
    sizes = np.diff(off)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        v = data[(off[rows][:, None] + np.arange(size)).ravel()].view(dtype).reshape(len(rows), -1).astype(float)
        v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        yield rows, v / np.sqrt((v * v).sum(1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch], k: int, tables: int, dtype: str, only_keys: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 500):
            part = batch.slice(a, 500)
            for rows, unit in _units(part.column("v"), dtype):
                keys = cells(unit, k, tables).ravel()
                if only_keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])
                    continue
                take = pa.array(np.repeat(rows, tables))
                table = pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), table, *(part.column(c).take(take) for c in ("rep", "copies", "v"))], ["key", "t", "rep", "copies", "v"])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(batches: Iterator[pa.RecordBatch], k: int, tables: int, dtype: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) of linked classes from rows in the order of their buckets."""
    held: pa.Table | None = None
    out: list[list[np.ndarray]] = []

    def bucket(rows: pa.Table) -> None:
        rep, copies, side = (rows.column(c).to_numpy() for c in ("rep", "copies", "side"))
        t = int(rows.column("t")[0].as_py())
        crossed = side.min() != side.max()  # a pair of blocks: only pairs across
        for own, unit in _units(rows.column("v"), dtype):
            order = own[np.argsort(rep[own], kind="stable")]
            unit = unit[np.argsort(rep[own], kind="stable")]
            pairs = []
            for a in range(0, len(unit), 512):
                i, j = np.nonzero(unit[a : a + 512] @ unit[a:].T >= threshold)
                i, j = i + a, j + a
                keep = i < j
                if crossed:
                    keep &= side[order[i]] != side[order[j]]
                pairs.append((i[keep], j[keep]))
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if not len(i):
                continue
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            codes = cells(unit[some], k, tables)[:, :t]
            i, j = at[: len(i)], at[len(i) :]
            ids, n = rep[order[some]], copies[order[some]]
            fresh = np.ones(len(i), bool)
            for a in range(0, len(i), 100_000):
                fresh[a : a + 100_000] = ~(codes[i[a : a + 100_000]] == codes[j[a : a + 100_000]]).any(1)
            links = np.bincount(i[fresh], n[j[fresh]], len(ids)) + np.bincount(j[fresh], n[i[fresh]], len(ids))
            out.append([ids, links.astype(np.int64), ids[_roots(len(ids), i, j)]])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        sub = rows.column("sub").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, sub[1:] != sub[:-1])), len(sub)).tolist() if len(sub) else [0]
        for a, b in zip(edge[:-2], edge[1:-1], strict=True):
            if b - a > 1:
                bucket(rows.slice(a, b - a))
        held = rows.slice(edge[-2]) if len(edge) > 1 else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "root"])
            out.clear()
    if held is not None and len(held) > 1:
        bucket(held)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "root"])


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Vectors link at a cosine of ``threshold`` or more; ``n_links`` counts the other
    vectors linked directly, ``component_id`` is the smallest vec_id that links reach.
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without vec_id, link with nothing; vectors of different lengths do not link. Equal
    vectors are one class, compared once and counted with their number. Other columns
    are ignored.

    A bucket beyond ``HOT`` vectors is cut into blocks and pairs of blocks, a task each:
    counting all links of a group compares all its pairs, but no task holds the group.
    """
    dtype = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    source = vectors.select("vec_id", "embedding")
    if dtype == "<f8":
        source = source.withColumn("embedding", F.col("embedding").cast("array<double>"))
    own = scratch.save(source.mapInArrow(partial(_vectors, dtype=dtype), "vec_id long, v binary"))
    classes = scratch.save(own.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    k, tables = shape(n, threshold)
    made = partial(_keyed, k=k, tables=tables, dtype=dtype)
    spread = classes.repartition(max(1, n // 5_000))  # a few thousand vectors make many rows
    hot = scratch.save(spread.mapInArrow(partial(made, only_keys=True), "key long").groupBy("key").agg(F.count("*").alias("size")).where(f"size > {HOT}"))
    keyed = spread.mapInArrow(partial(made, only_keys=False), "key long, t int, rep long, copies long, v binary")
    found = hot.count()
    if found:
        keyed = keyed.join(F.broadcast(hot) if found <= BROADCAST_KEYS else hot, "key", "left")
        blocks = F.ceil(F.col("size") / (HOT // 2)).cast("int")
        keyed = keyed.withColumn("blocks", F.coalesce(blocks, F.lit(1))).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = keyed.withColumn("sub", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))))
    else:
        keyed = keyed.withColumns({"sub": F.col("key"), "side": F.lit(0)})
    placed = keyed.select("sub", "t", "rep", "copies", "v", "side").repartition("sub").sortWithinPartitions("sub")
    part = scratch.save(placed.mapInArrow(partial(_links, k=k, tables=tables, dtype=dtype, threshold=threshold), "rep long, links long, root long"))
    links = part.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(part.select("rep", "root"), scratch).select(F.col("v").alias("rep"), "component")
    classes = classes.join(links, "rep", "left").join(comp, "rep", "left")
    out = own.join(classes, "v", "left")
    cid = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id", F.when(F.col("rep").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"),
    )
