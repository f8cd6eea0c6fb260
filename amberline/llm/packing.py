"""Best-fit packing with large-item matching of tokenised documents (operator 2).

Tokenising runs per batch: pieces of text (runs of letters, single digits, runs of other
marks) are found for all rows at once, and the tokenizer sees each distinct piece once
a worker. Rows with anything out of the ordinary (other scripts, contractions, controls)
go to the tokenizer as they are; both ways give its ids exactly.

Packing needs only how many pieces there are of each length, at most ``capacity``
counts, so the plan is made on the driver whatever the corpus, and dealt out by rank:
the r-th piece of a length goes to the place that the plan gives to rank r.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amberline.llm import text as X
from amberline.llm.scratch import Scratch

#: Distinct pieces a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
#: Ranks within a length are counted in this many parts for each million rows.
PARTS_A_MILLION = 16

_state: dict = {}


def _tokenizer(path: str):
    if _state.get("path") != path:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        # the first two bytes of what the tokenizer finds in a text before anything else
        marks = {t.content.encode()[:2] for t in tok.get_added_tokens_decoder().values()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        _state.update(path=path, tok=tok, chars=chars, cache={}, marks=marks)
    return _state["tok"]


_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:] = _LETTER
_ORDINARY = np.zeros(256, bool)
_ORDINARY[[9, 10, 13, *range(0x20, 0x7F), 0xC3, *range(0x80, 0xC0)]] = True
_AFTER_QUOTE = np.zeros(256, bool)
_AFTER_QUOTE[[ord(c) for c in "stmdrvlSTMDRVL"]] = True


def encode_rows(data: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids (uint32) of all rows, and where each row's begin."""
    tok = _tokenizer(path)
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    after = np.append(data[1:], 0)
    odd = ~_ORDINARY[data]
    odd |= (data == 0x27) & _AFTER_QUOTE[after]
    for mark in _state["marks"]:
        odd |= (data == mark[0]) & (after == mark[-1])
    lead = np.append(False, data[:-1] == 0xC3)
    odd |= (data >= 0x80) & (data < 0xC0) & ~lead
    count = np.concatenate([[0], np.cumsum(odd)])
    slow = count[off[1:]] > count[off[:-1]]
    text = X.LOWER[data]
    capital = lead & (data <= 0x9E) & (data != 0x97)
    text[capital] += 0x20
    kind = _CLASS[text]
    mark = lead & ((data == 0x97) | (data == 0xB7))  # the multiplication and division signs
    kind[mark] = _OTHER
    kind[np.flatnonzero(mark) - 1] = _OTHER
    start = kind != np.append(0, kind[:-1])
    start |= kind == _DIGIT
    start[off[off < len(data)]] = True
    start &= kind > 0
    begin = np.flatnonzero(start)
    # a piece ends where the next begins or where white space begins
    stop = np.append(begin[1:], len(data))
    space = np.flatnonzero((kind == 0) & np.append(True, kind[:-1] != 0))
    near = np.searchsorted(space, begin)
    stop = np.minimum(stop, np.append(space, len(data))[near])
    row = np.searchsorted(off, begin, "right") - 1
    if slow.any():
        fast = ~slow[row]
        begin, stop, row = begin[fast], stop[fast], row[fast]
    h = X.hash_words(text, begin, stop)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    raw, cache, chars = text.tobytes(), _state["cache"], _state["chars"]
    if len(cache) > REMEMBERED:
        cache.clear()
    known = []
    for i, j in zip(begin[first].tolist(), stop[first].tolist(), strict=True):
        piece = raw[i:j]
        ids = cache.get(piece)
        if ids is None:
            ids = cache[piece] = np.array([x.id for x in tok.model.tokenize("".join(map(chars.__getitem__, piece)))], np.uint32).tobytes()
        known.append(ids)
    size = np.array([len(x) >> 2 for x in known], np.int64)
    flat = np.frombuffer(b"".join(known), np.uint32)
    base = np.cumsum(size) - size
    counts = size[inverse]
    ids = flat[X.spread(base[inverse], counts)]
    per = np.bincount(row, counts, rows).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(per)])
    if slow.any():
        parts = [ids[at[r] : at[r + 1]] for r in range(rows)]
        which = np.flatnonzero(slow)
        whole = data.tobytes()
        for r, e in zip(which, tok.encode_batch([whole[off[r] : off[r + 1]].decode("utf-8", "replace") for r in which], add_special_tokens=False), strict=True):
            parts[r] = np.array(e.ids, np.uint32)
        ids = np.concatenate(parts)
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return ids, at


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in X.slices(batch.column("text")):
            ids, at = encode_rows(data, off, path)
            docs, number, start, length, crc = [], [], [], [], []
            raw, stop = ids.astype("<u4").tobytes(), np.uint32(end).astype("<u4").tobytes()
            for r in range(b - a):
                n = int(at[r + 1] - at[r]) + 1
                own = raw[at[r] * 4 : at[r + 1] * 4] + stop
                for k in range(0, n, capacity):
                    docs.append(r)
                    number.append(k // capacity)
                    start.append(k)
                    length.append(min(capacity, n - k))
                    crc.append(zlib.crc32(own[4 * k : 4 * (k + capacity)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b].take(pa.array(docs)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, first rank, end rank, first bin, pieces a bin, offset) and the number of bins.

    Large pieces, over a third of the capacity, go at most two to a bin: the longest
    left takes the longest other that fits. Smaller ones, longest first, go to the bin
    with the smallest gap that takes them. All on runs of equal bins.
    """
    left = {s: n for s, n in counts.items() if n}
    used, out, bins = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first bin, bins)

    def place(s: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((s, used[s], used[s] + n, first, each, offset))
        used[s] += n
        left[s] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        fits = large[: bisect_left(large, capacity - s + 1)]
        if fits:
            p = fits[-1]
            n = min(left[s], left[p]) if p != s else left[s] // 2
        if fits and n:
            if p == s:
                place(s, 2 * n, bins, 2, 0)
            else:
                place(s, n, bins, 1, 0)
                place(p, n, bins, 1, s)
            gaps.setdefault(capacity - s - p, []).append((bins, n))
        else:
            # nothing fits beside it, or only one piece of this length is left and it is the longest that would
            others = [x for x in fits if x != s]
            n = left[s]
            if others and n == 1:
                p = others[-1]
                place(s, 1, bins, 1, 0)
                place(p, 1, bins, 1, s)
                gaps.setdefault(capacity - s - p, []).append((bins, 1))
                n = 1
            else:
                place(s, n, bins, 1, 0)
                gaps.setdefault(capacity - s, []).append((bins, n))
        bins += n
        large = [x for x in large if left[x]]
    open_gaps = sorted(gaps)
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(open_gaps, s)
            if i == len(open_gaps):
                each = capacity // s
                n, gap = max(1, left[s] // each), capacity
                gaps.setdefault(gap, []).append((bins, n))
                insort(open_gaps, gap)
                bins += n
                continue
            gap = open_gaps[i]
            first, n = gaps[gap].pop()
            each = min(gap // s, left[s])
            take = min(n, left[s] // each)
            place(s, take * each, first, each, capacity - gap)
            rest = [(gap, first + take, n - take), (gap - each * s, first, take)]
            if not gaps[gap]:
                del gaps[gap], open_gaps[i]
            for g, f, m in rest:
                if m:
                    if g not in gaps:
                        gaps[g] = []
                        insort(open_gaps, g)
                    gaps[g].append((f, m))
    return out, bins


def pack(docs: DataFrame, scratch: Scratch, path: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece of each row of ``docs``.

    A document is its token ids and then ``end``; only documents longer than
    ``capacity`` are cut, into pieces of that length and a last one. A null or empty
    text is the one token ``end``. Pieces fill sequences of at most ``capacity`` tokens
    without gaps from offset 0. Repeated rows are packed each; a null doc_id stays null. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = scratch.save(
        docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=path, end=end, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    )
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    placed, _ = plan(counts, capacity)
    total = sum(counts.values())
    parts = max(1, total * PARTS_A_MILLION // 1_000_000)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    own = pieces.withColumn("part", part)
    sizes = own.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")))
    ranked = ranked.join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    # the plan's rows are bounded by the capacity, not by the corpus
    table = spark.createDataFrame(placed or [(0,) * 6], "plan_length long, low long, high long, first long, each long, base long")
    fits = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    out = ranked.join(F.broadcast(table), fits)
    at = F.col("rank") - F.col("low")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
