"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically (operator 7).

Features of a text: densities of a fixed word list and of a lexicon learned from
labelled rows (whole words and word beginnings that mark toxic texts), how near their
hits are to words in the second person, capitals, punctuation and obfuscation.
The lexicon, the trees and the calibration are fitted on a bounded sample of labelled
rows, cross-fitted in two halves so that no row is judged by what it taught; counting
for the lexicon and all scoring run on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm import text as X
from amberline.llm.scratch import Scratch

#: Labelled rows that the model is fitted on at most, and lexicon entries at most of each kind.
SAMPLE, LEXICON = 12_000, 4_000
#: A lexicon entry is in this many toxic texts at least, which are this share of all its texts.
SUPPORT, PRECISION = 4, 0.75
#: Lengths in bytes of word beginnings; 0 is the whole word.
KINDS = (0, 4, 5, 6, 8)

INSULTS = (
    "idiot idiots moron stupid dumb loser losers trash garbage worthless pathetic disgusting scum clown fool ugly hate "
    "shut kill die bastard crap damn hell jerk creep freak filth vermin pig "
    "dumm idioten dreck abschaum versager widerlich blöd imbécile crétin ordure minable dégoûtant estúpido basura asqueroso inútil"
).split()
SECOND_PERSON = "you your yours yourself youre u ur du dein deine dich dir ihr euch tu te toi ton ta vous votre usted tú ti vosotros".split()

FEATURES = ("words", "listed", "listed_count", "second", "near_second", "capitals", "shouted", "exclaim", "marks", "digits", "mixed", "long_runs", *(f"{w}_{k}" for k in KINDS for w in ("density", "count", "weight")))


def _hash_list(words: list[str]) -> np.ndarray:
    data, off = X.rows_of(pa.array(words))
    return np.sort(X.hash_words(data, off[:-1], off[1:]))


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == x, at, -1)


_LISTED, _SECOND = _hash_list(INSULTS), _hash_list(SECOND_PERSON)
_LETTERS = X.ALNUM.copy()
_LETTERS[0x30:0x3A] = False


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of whole words or of their beginnings; 0 for words that are too short."""
    if not kind:
        return X.hash_words(data, starts, ends)
    long = ends - starts >= kind
    h = X.hash_words(data, starts, np.minimum(ends, starts + kind))
    return np.where(long, h, np.uint64(0))


def features(data: np.ndarray, off: np.ndarray, lexicon: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of features for each row of bytes, of that row alone. lexicon: (sorted hashes, weights) for each kind."""
    rows = len(off) - 1
    out = np.zeros((rows, len(FEATURES)))
    if not len(data):
        return out
    low = X.LOWER[data]
    starts, ends, first = X.words(low, off, _LETTERS)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    size = np.maximum(np.diff(off), 1)
    per = lambda x: np.bincount(row, x, rows)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    words = np.maximum(n, 1)
    whole = _word_hashes(low, starts, ends, 0)
    listed, second = _within(_LISTED, whole) >= 0, _within(_SECOND, whole) >= 0
    hit = listed.copy()
    columns = [np.log1p(n), per(listed) / words, np.log1p(per(listed)), per(second) / words]
    learned = []
    for kind, (hashes, weights) in zip(KINDS, lexicon, strict=True):
        at = _within(hashes, _word_hashes(low, starts, ends, kind))
        got = at >= 0
        hit |= got
        w = np.where(got, weights[at] if len(weights) else 0.0, 0.0)
        learned += [per(got) / words, np.log1p(per(got)), per(w) / np.sqrt(words)]
    seen, i = np.concatenate([[0], np.cumsum(second)]), np.arange(len(second))
    near = seen[np.minimum(i + 6, first[1:][row])] > seen[np.maximum(i - 5, first[:-1][row])]  # five words to each side, of this text only
    upper = (data >= 0x41) & (data <= 0x5A)
    letters = _LETTERS[low]
    up = np.concatenate([[0], np.cumsum(upper)])
    shouted = (up[ends] - up[starts] == ends - starts) & (ends - starts > 2)
    marks = (data > 0x20) & (data < 0x80) & ~X.ALNUM[low]
    digit = (data >= 0x30) & (data <= 0x39)
    odd = digit | np.isin(data, np.frombuffer(b"@$!*#%&", np.uint8))
    inner = np.zeros(len(data), bool)  # a digit or mark between two letters
    inner[1:-1] = odd[1:-1] & letters[:-2] & letters[2:]
    runs = np.zeros(len(data), bool)  # the third of three equal letters
    runs[2:] = letters[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    head, tail = off[off < len(data)], off[off > 0] - 1  # of each text; neither looks beyond them
    inner[head] = inner[tail] = runs[head] = False
    runs[head[head + 1 < len(data)] + 1] = False
    columns += [per(hit & near) / words, total(upper) / size, per(shouted) / words, total(data == 0x21) / size, total(marks) / size, total(digit) / size, total(inner) / words, total(runs) / words]
    out[:] = np.stack([*columns, *learned], 1)
    return out


# --- trees -------------------------------------------------------------------------------------------


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: float = 3.0) -> dict:
    """Gradient boosting on the logistic loss with histogram splits; features beyond an edge go right."""
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    d = x.shape[1]
    flat = binned + np.arange(d) * bins
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node, tree = np.zeros(len(y), np.int64), np.full((2**depth - 1, 2), -1.0)
        for level in range(depth):
            for k in range(2**level):
                at = 2**level - 1 + k
                mine = np.flatnonzero(node == at)
                if len(mine):
                    cells = flat[mine].ravel()
                    sums = [np.bincount(cells, np.repeat(v[mine], d), d * bins).reshape(d, bins).cumsum(1) for v in (g, h)]
                    tg, th = sums[0][:, -1:], sums[1][:, -1:]
                    gain = sums[0] ** 2 / (sums[1] + 1) + (tg - sums[0]) ** 2 / (th - sums[1] + 1) - tg**2 / (th + 1)
                    gain[(sums[1] < least / 4) | (th - sums[1] < least / 4)] = -1
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        tree[at] = j, edges[j][b]
                go = 2 * at + 1
                if tree[at, 0] < 0:
                    node[mine] = go
                else:
                    node[mine] = go + (x[mine, int(tree[at, 0])] > tree[at, 1])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        score += value[leaf]
        trees.append((tree, value))
    return {"base": base, "trees": trees, "depth": depth}


def score_trees(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    for tree, value in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            j = tree[node, 0].astype(np.int64)
            right = (j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > tree[node, 1])
            node = 2 * node + 1 + right
        out += value[node - (2 ** model["depth"] - 1)]
    return out


def fit_isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone fit of y on s (pool adjacent violators)."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # value, weight, first score, last score
    for score, label in zip(s[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([label, 1.0, score, score])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, last = blocks.pop()
            top = blocks[-1]
            top[0] = (top[0] * top[1] + v * w) / (top[1] + w)
            top[1] += w
            top[3] = last
    knots = [(x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
    return np.array([x for x, _ in knots]), np.array([v for _, v in knots])


def calibrated(model: dict, x: np.ndarray) -> np.ndarray:
    raw = score_trees(model, x)
    at, value = model["knots"]
    # the raw score orders what the calibration ties
    return np.clip(0.999 * np.interp(raw, at, value) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


# --- the operator ------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each word or beginning is: (kind, h, half, texts, toxic), summed a batch."""
    for batch in batches:
        half, toxic = batch.column("half").to_numpy(), batch.column("toxic").to_numpy()
        for a, b, data, off in X.slices(batch.column("text")):
            low = X.LOWER[data]
            starts, ends, first = X.words(low, off, _LETTERS)
            row = np.repeat(np.arange(b - a), np.diff(first))
            for kind in KINDS:
                h = _word_hashes(low, starts, ends, kind)
                order = np.lexsort((row, h))
                once = np.ones(len(h), bool)
                once[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                h, r = h[order][once], row[order][once]
                r, h = r[h > 0], h[h > 0]
                u, inverse = np.unique(h, return_inverse=True)
                for k in (0, 1):
                    mine = half[a:b][r] == k
                    texts = np.bincount(inverse[mine], minlength=len(u))
                    bad = np.bincount(inverse[mine], toxic[a:b][r[mine]], len(u)).astype(np.int64)
                    some = texts > 0
                    m = int(some.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, kind, np.int32)), pa.array(u[some].view(np.int64)), pa.array(np.full(m, k, np.int32)), pa.array(texts[some]), pa.array(bad[some])], ["kind", "h", "half", "texts", "toxic"]
                    )


def _features(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Features of sampled rows, by the lexicon of the other half."""
    for batch in batches:
        half = batch.column("half").to_numpy()
        for a, b, data, off in X.slices(batch.column("text")):
            both = [features(data, off, lexicon) for lexicon in shared.value]
            x = np.where((half[a:b] == 0)[:, None], both[1], both[0])
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("half")[a:b], batch.column("toxic")[a:b], values], ["half", "toxic", "x"])


def _lexicon(rows: list, halves: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for kind in KINDS:
        sums: dict[int, list[int]] = {}
        for r in rows:
            if r.kind == kind and r.half in halves:
                s = sums.setdefault(r.h, [0, 0])
                s[0] += r.texts
                s[1] += r.toxic
        own = sorted((h & (1 << 64) - 1, np.log((t + 0.5) / (n - t + 0.5))) for h, (n, t) in sums.items() if t >= SUPPORT and t >= PRECISION * n)
        out.append((np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own], float)))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, scratch: Scratch, sample: int = SAMPLE) -> dict | None:
    """The model, from rows of ``labels`` (doc_id, toxic) where ``learn`` holds; None without rows of both labels."""
    sc = docs.sparkSession.sparkContext
    own = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)  # bounded, so it can be broadcast
    own = own.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int"))
    rows = scratch.save(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "half", "toxic"))
    counts = rows.mapInArrow(_count_words, "kind int, h long, half int, texts long, toxic long").groupBy("kind", "h", "half").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    # entries of either half or of both; the best of each kind, so that their number is bounded
    both = counts.groupBy("kind", "h").agg(F.sum("texts").alias("n"), F.sum("toxic").alias("t"), F.max(F.expr(f"int(toxic >= {SUPPORT} and toxic >= {PRECISION} * texts)")).alias("good"))
    good = both.where((F.col("good") == 1) | ((F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * F.col("n"))))
    best = None
    for kind in KINDS:
        top = good.where(F.col("kind") == kind).orderBy(F.desc("t"), "h").limit(LEXICON)
        best = top if best is None else best.unionAll(top)
    entries = counts.join(F.broadcast(best.select("kind", "h")), ["kind", "h"]).collect()  # at most 2 * LEXICON rows a kind
    lexica = [_lexicon(entries, (0,)), _lexicon(entries, (1,))]
    got = rows.mapInArrow(partial(_features, shared=sc.broadcast(lexica)), "half int, toxic int, x array<double>").collect()  # ``sample`` rows
    got = sorted(got, key=lambda r: (r.half, r.toxic, r.x))
    y = np.array([r.toxic for r in got], float)
    if len({*y.tolist()}) < 2:
        return None
    x, half = np.array([r.x for r in got]), np.array([r.half for r in got])
    apart = np.zeros(len(y))
    for k in (0, 1):
        rest, mine = half != k, half == k
        apart[mine] = score_trees(fit_trees(x[rest], y[rest]), x[mine]) if rest.any() and 0 < y[rest].mean() < 1 else 0.0
    return {**fit_trees(x, y), "knots": fit_isotonic(apart, y), "lexicon": _lexicon(entries, (0, 1))}


def _score(batches: Iterator[pa.RecordBatch], shared, column: str) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        out = np.zeros(len(batch))
        if model is not None:
            for a, b, data, off in X.slices(batch.column("text")):
                out[a:b] = calibrated(model, features(data, off, model["lexicon"]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, column])


def add_score(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text; null and empty texts are scored as empty.

    Other columns pass unchanged; one named like ``column`` is replaced. Without a model
    (no labels of both kinds) every score is 0.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(partial(_score, shared=shared, column=column), f"{fields}, `{column}` double")


def held_out() -> Column:
    """Rows that the labels of are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``. A null doc_id is not held out."""
    model = fit(docs, labels, ~held_out(), scratch, sample)
    out = add_score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
