"""Fuzzy line dedup by MinHash, in DataFrame operations only (operator 5).

A line's set holds the hashes of its K-character shingles (UTF-16 units; a shorter line
is one shingle). Its signature has 24 positions, least values over the set: 4 hashes of
each shingle, each taken from its bits 0, 8, 16, 24, 32 and 40 on. Every position orders the set
anew by bits of its own, so two sets agree in each with the probability of their Jaccard
similarity. One pass of hashes, shifts and minima, compiled by whole-stage code generation,
gives all of them, in the tasks that merge equal lines; a row holds 4 shingles, whose
least values are found before the line's are looked up. 16 bands of 3 positions, each
position in two of them, meet a pair of similarity 0.8 but for about 3.5e-4, and of such
pairs 4e-5 differ in more than 13 positions (a test measures both); links are confirmed on
the full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.buckets import bind, lanes_differ, link_buckets
from amberline.llm.scratch import Scratch

POSITIONS, DIFFER = 24, 13
#: Positions of one hash of a shingle, and the bits that each leaves out before the next.
SHIFTS, STEP = 6, 8
#: Shingles of a line that one row holds.
ROW = 4

#: The positions of each band: by rows, then by columns of a table of 8 by 3.
_BANDS = [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(8)] + [(i, i + 8, i + 16) for i in range(8)]
#: Bands whose keys are shuffled in one go.
GROUP = 4
#: Bits of a position that a signature keeps, four positions in each of its longs.
BITS = 16


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, h1, h2) of the lines that are not blank, without rows that lack a doc_id."""
    each = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.where(F.col("line").rlike(r"[^ \t\r]"))
    return each.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _shingle_hashes(line: Column, k: int) -> Column:
    """The distinct shingle hashes of a line as an array."""

    def hashes(unit: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), _last(unit, k), F.lit(2)), lambda i: F.xxhash64(F.substring(unit, i, F.lit(2 * k))))

    return F.array_distinct(bind(F.encode(line, "UTF-16BE"), hashes))  # outside, so that it is compiled


def _last(unit: Column, k: int) -> Column:
    """The place (from 1) of the byte where the last shingle of a line in UTF-16 begins."""
    return F.greatest(F.octet_length(unit) - 2 * k + 1, F.lit(1)).cast("int")


def signatures(each: DataFrame, by: tuple[str, ...] = ("v",), also: tuple[str, ...] = (), of: tuple[str, ...] = ("h",)) -> DataFrame:
    """(*by, *also, sig, keys) of rows (*by, *also, *of): low bits of the positions, a key for each band.

    of: columns with hashes of shingles, which may repeat. also: columns that have one value for each ``by``.
    """
    more = [F.xxhash64(F.lit(g), h).alias(f"{h}_{g}") for g in range(1, POSITIONS // SHIFTS) for h in of]
    each = each.select(*by, *also, *[F.col(h).alias(f"{h}_0") for h in of], *more)
    mins = []
    for i in range(POSITIONS):
        values = [F.shiftleft(f"{h}_{i // SHIFTS}", STEP * (i % SHIFTS)) for h in of]
        # the lowest bits are gone by the shift
        mins.append(F.shiftrightunsigned(F.min(F.least(*values) if len(values) > 1 else values[0]), STEP * (SHIFTS - 1)).alias(f"m{i}"))
    sig = each.groupBy(*by).agg(*mins, *[F.min(c).alias(c) for c in also])
    lanes = []
    for j in range(0, POSITIONS, 64 // BITS):
        x = F.col(f"m{j}").bitwiseAND(F.lit((1 << BITS) - 1))
        for i in range(1, 64 // BITS):
            x = x.bitwiseOR(F.shiftleft(F.col(f"m{j + i}").bitwiseAND(F.lit((1 << BITS) - 1)), BITS * i))
        lanes.append(x)
    sig = sig.select(*by, *also, F.array(*lanes).alias("sig"))
    return sig.select(*by, *also, "sig", F.array(*band_keys(F.col("sig"))).alias("keys"))


def band_keys(sig: Column) -> list[Column]:
    """For each band a long with the number of the band and the bits of its positions."""

    def lane(i: int) -> Column:
        per = 64 // BITS
        return F.shiftrightunsigned(sig[i // per], BITS * (i % per)).bitwiseAND(F.lit((1 << BITS) - 1))

    keys = []
    for b, at in enumerate(_BANDS):
        key = F.lit(b << 3 * BITS)
        for n, i in enumerate(at):
            key = key.bitwiseOR(F.shiftleft(lane(i), BITS * n))
        keys.append(key)
    return keys


def close(a: str, b: str) -> Column:
    """Whether the signatures in two columns differ in few enough positions."""
    return sum((lanes_differ(F.col(a)[i], F.col(b)[i], BITS) for i in range(1, POSITIONS * BITS // 64)), lanes_differ(F.col(a)[0], F.col(b)[0], BITS)) <= DIFFER


def shingle_rows(each: DataFrame, k: int, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, x0, x1, ...) of rows (*keep, unit): hashes of ``ROW`` shingles a row of a line in UTF-16."""
    each = each.select(*keep, "unit", _last(F.col("unit"), k).alias("last"))
    each = each.select(*keep, "unit", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * ROW))).alias("i"))
    at = [F.least(F.col("i") + 2 * j, "last") if j else F.col("i") for j in range(ROW)]  # the last shingle again where a row is not full
    return each.select(*keep, *[F.xxhash64(F.substring("unit", at[j], F.lit(2 * k))).alias(f"x{j}") for j in range(ROW)])


def fuzzy_lines(docs: DataFrame, scratch: Scratch, k: int = 8, percent: int = 80) -> DataFrame:
    """Where lines that have another occurrence or a near copy are kept: (h1, h2, keep_doc, keep_pos)."""
    seen = line_rows(docs).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("times"), F.first("line").alias("line"))
    unit = seen.select("h1", "h2", "at.doc_id", "at.pos", "times", F.encode("line", "UTF-16BE").alias("unit"))
    each = shingle_rows(unit, k, ("h1", "h2", "doc_id", "pos", "times"))
    # grouped by what the rows are dealt out by already: the minima are not shuffled
    sig = signatures(each, ("h1", "h2"), ("doc_id", "pos", "times"), tuple(f"x{j}" for j in range(ROW)))
    lines = scratch.save(sig.select(F.monotonically_increasing_id().alias("v"), "h1", "h2", F.struct("doc_id", "pos").alias("at"), "times", "sig"))

    def nodes_of(wanted: DataFrame) -> DataFrame:
        # texts travel whole, once, and are split where they meet the places wanted; other rows of the doc_id may lack the place
        at = lines.join(wanted, "v").select("at.doc_id", F.struct("v", "sig", "h1", "h2", "at.pos").alias("o"))
        at = at.groupBy("doc_id").agg(F.collect_list("o").alias("own"))
        own = docs.select("doc_id", "text").join(at.hint("shuffle_hash"), "doc_id").select(F.split("text", "\n").alias("each"), "own")
        own = own.select("each", F.explode("own").alias("o")).select("o.*", F.get("each", F.col("o.pos")).alias("x"))
        return own.where((F.xxhash64("x") == F.col("h1")) & (F.xxhash64(F.lit(1), "x") == F.col("h2"))).select("v", "sig", "x")

    keyed = [lines.select(F.explode(F.array(*band_keys(F.col("sig"))[b : b + GROUP])).alias("key"), "v") for b in range(0, len(_BANDS), GROUP)]
    comp = link_buckets(keyed, nodes_of, lambda x: _shingle_hashes(x, k), close, percent, scratch)
    narrow = lines.select("v", "h1", "h2", "at", "times").join(comp, "v", "left")
    cid = F.coalesce("component", "v")
    linked = comp.select("component").distinct().withColumnRenamed("component", "c")
    many = narrow.withColumn("c", cid).join(linked, "c", "left_semi")
    first = many.groupBy("c").agg(F.min("at").alias("keep"))
    many = many.join(first, "c").select("h1", "h2", "keep")
    one = narrow.withColumn("c", cid).join(linked, "c", "left_anti").where("times > 1").select("h1", "h2", F.col("at").alias("keep"))
    return many.unionAll(one).select("h1", "h2", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.pos").alias("keep_pos"))


def removed_lines(docs: DataFrame, scratch: Scratch, k: int = 8, percent: int = 80) -> DataFrame:
    """(doc_id, gone): the places of the lines that go, for documents that lose any."""
    inner = Scratch(docs.sparkSession, "lines")
    keep = scratch.save(fuzzy_lines(docs, inner, k, percent))
    inner.clear()
    rows = line_rows(docs).drop("line").join(keep, ["h1", "h2"]).where("doc_id <> keep_doc or pos <> keep_pos")
    gone = scratch.save(rows.groupBy("doc_id").agg(F.collect_set("pos").alias("gone")))
    scratch.drop(keep)
    return gone


def line_dedup(docs: DataFrame, scratch: Scratch, k: int = 8, percent: int = 80) -> DataFrame:
    """``docs`` with text and two more columns, n_lines and n_lines_removed: near copies of lines go.

    Lines split at newlines. Lines whose shingle sets have a Jaccard similarity of
    percent / 100 or more link; of each component the earliest line, by (doc_id, place),
    stays and every other occurrence goes. Blank lines always stay, as do lines of rows
    without a doc_id. Null texts stay null; a text may become empty, no row goes. Rows
    that share a doc_id are each treated as that document. Other columns pass unchanged; columns
    named n_lines or n_lines_removed are replaced.
    """
    gone = removed_lines(docs, scratch, k, percent).withColumnRenamed("doc_id", "_gone_doc").withColumnRenamed("gone", "_gone_at")
    out = docs.drop("n_lines", "n_lines_removed")
    # not sorted by doc_id, with the texts, to meet so few rows
    out = out.join(gone.hint("shuffle_hash"), out["doc_id"] == F.col("_gone_doc"), "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone_at", i))
    return out.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"),
            "n_lines_removed": F.when(F.col("_gone_at").isNull(), 0).otherwise(F.size("_gone_at")).cast("long"),
            "text": F.when(F.col("_gone_at").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
        }
    ).drop("_gone_doc", "_gone_at")
