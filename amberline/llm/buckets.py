"""Components of candidates that share buckets, without listing a bucket's pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.components import components
from amberline.llm.scratch import Scratch

#: Members of a bucket's largest component that the others are held against in a round, and how often at most.
PIVOTS, ROUNDS = 8, 3
#: Share of the members outside that a round must link for another one to follow; what is left costs less by bit maps then.
WORTH = 0.25
#: Buckets of so many members at most pass no rounds.
SMALL = 8
#: Longs of a set's bit map, and members of a bucket that one key of the last join holds on average, at most.
WORDS, BLOCK = 16, 1024


def lanes_differ(a: Column, b: Column, bits: int) -> Column:
    """In how many lanes of ``bits`` bits (8 or 16) two longs differ."""
    x = a.bitwiseXOR(b)
    for by in (8, 4, 2, 1)[bits == 8 :]:
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001 if bits == 16 else 0x0101010101010101)))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def link_buckets(
    keyed: list[DataFrame],
    nodes_of: Callable[[DataFrame], DataFrame],
    as_set: Callable[[Column], Column],
    close: Callable[[str, str], Column],
    percent: int,
    scratch: Scratch,
) -> DataFrame:
    """(v, component) of all links among vertices that share a key; only vertices that are not the least.

    keyed: tables (key, v) without a key in common; one is shuffled at a time. nodes_of: (v, sig, x), a signature and the content of each v wanted, asked for once.
    as_set: the whole set of a content as an array of longs without repeats. close: whether the
    signatures in two named columns are near enough.
    Sets link when 100 * intersection >= percent * union.

    1. Every member of a bucket is held against the bucket's least member, its lead; first the one lead
       that it shares most keys with, then those that are not in its component already.
    2. Where the other members of a bucket of more than ``SMALL`` still form several components, those
       outside the largest one are held against ``PIVOTS`` of its members, drawn by hash, in up to
       ``ROUNDS`` rounds, as long as a round links ``WORTH`` of those it holds; one of them meets ``PIVOTS``
       members in all, however many buckets it is in. So a large group of near copies falls together in
       rows proportional to its size.
    3. In buckets that stay divided, members outside the largest component are held against all members of
       other components by bit maps: of ``64 * WORDS`` bits, each item of a set turns one over, so two
       sets differ in as many items at least as their maps in bits. Pairs that this bound lets pass
       are confirmed. That is exact; only pairs that link or nearly do leave the join, though the maps
       of a divided bucket are compared pair by pair (16 words a pair, in blocks of ``BLOCK`` members).
    """
    members = None
    for part in keyed:
        # one shuffle for the bounds and for the members: with a filter that only one of the two infers it would be done twice
        part = part.where("key is not null and v is not null").repartition("key")
        ends = part.groupBy("key").agg(F.min("v").alias("lead"), F.max("v").alias("last")).where("lead < last").select("key", "lead")
        some = scratch.save(part.join(ends.hint("shuffle_hash"), "key").where("v <> lead"))
        members = some if members is None else members.unionAll(some)
    nodes = scratch.save(nodes_of(members.select(F.explode(F.array("v", "lead")).alias("v")).distinct()))
    side = lambda x: nodes.select(F.col("v").alias(x), F.col("sig").alias("s" + x), F.col("x").alias("x" + x))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that link; contents travel for those alone whose signatures are near."""
        near = pairs.join(side("a").drop("xa"), "a").join(side("b").drop("xb"), "b").where(close("sa", "sb")).select("a", "b")
        near = scratch.save(near)
        both = near.join(side("a").drop("sa"), "a").join(side("b").drop("sb"), "b")
        # a row of its own: else the filter would work a set out once for each time it names it
        both = both.select("a", "b", F.explode_outer(F.array(F.struct(as_set(F.col("xa")).alias("a"), as_set(F.col("xb")).alias("b")))).alias("s"))
        # 100 * intersection >= percent * (sizes - intersection)
        links = (100 + percent) * F.size(F.array_intersect("s.a", "s.b")) >= percent * (F.size("s.a") + F.size("s.b"))
        out = scratch.save(both.where(links).select("a", "b"))
        scratch.drop(near)
        return out

    def divided(members: DataFrame, comp: DataFrame) -> DataFrame:
        """Members (key, v, c, main, size) of buckets whose members other than the lead are of several components."""
        named = members.join(comp.select("v", F.col("component").alias("c")), "v", "left").select("key", "v", F.coalesce("c", "v").alias("c"))
        sizes = named.groupBy("key", "c").agg(F.count("*").alias("n"))
        mains = sizes.groupBy("key").agg(F.max(F.struct("n", F.col("c").alias("main"))).alias("m"), F.count("*").alias("kinds"), F.sum("n").alias("size")).where("kinds > 1")
        return scratch.save(named.join(mains.select("key", "m.main", "size"), "key"))

    leads = scratch.save(members.groupBy(F.col("v").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("n")))
    best = scratch.save(leads.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    links = confirm(best)
    comp = components(links, scratch)
    rest = leads.select("a", "b").join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(comp.select(F.col("v").alias(end), F.col("component").alias("c" + end)), end, "left")
    more = confirm(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    links = links.unionAll(more)
    comp = components(links, scratch)
    scratch.drop(leads, best)
    named = divided(members, comp)
    big = F.col("size") > SMALL
    for turn in range(ROUNDS):
        least = [F.min(F.struct(F.xxhash64("v", F.lit(turn * PIVOTS + i)).alias("h"), "v")).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = named.where(big & (F.col("c") == F.col("main"))).groupBy("key").agg(*least).select("key", F.array_distinct(F.array(*[f"p{i}.v" for i in range(PIVOTS)])).alias("bs"))
        outside = named.where(big & (F.col("c") != F.col("main"))).select("key", F.col("v").alias("a"))
        held = scratch.save(outside.join(pivots, "key").groupBy("a").agg(F.slice(F.array_distinct(F.flatten(F.collect_list("bs"))), 1, PIVOTS).alias("bs")))
        more = confirm(held.select("a", F.explode("bs").alias("b")))
        found = more.select("a").distinct().count()
        if found:
            links = links.unionAll(more)
            comp = components(links, scratch)
            before, named = named, divided(named.select("key", "v"), comp)  # others do not come apart again
            scratch.drop(before)
        if found < WORTH * held.count():
            break
    pairs = _map_pairs(named, nodes, as_set, percent, scratch)
    more = confirm(pairs)
    return comp if more.isEmpty() else components(links.unionAll(more), scratch)


def _map_pairs(named: DataFrame, nodes: DataFrame, as_set: Callable[[Column], Column], percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components in a bucket of ``named`` (key, v, c, main, size) that may link, each once."""
    sets = nodes.join(named.select("v").distinct(), "v").select("v", as_set(F.col("x")).alias("s"))
    # outer: else a filter on the array's size is inferred, which works the sets out for all nodes before the join
    item = sets.select("v", F.explode_outer("s").alias("t")).withColumn("h", F.xxhash64("t"))
    item = item.select("v", "t", F.pmod("h", F.lit(WORDS)).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("w") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)]
    maps = item.groupBy("v").agg(F.count("t").alias("n"), *words)
    own = named.groupBy("v").agg(F.collect_list("key").alias("keys"))
    held = scratch.save(named.withColumn("parts", F.ceil(F.col("size") / BLOCK)).join(maps, "v").join(own, "v"))
    each = ("v", "c", "n", "keys", *[f"w{i}" for i in range(WORDS)])
    a = held.where("c <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    a = a.select("key", "part", *[F.col(x).alias(x + "a") for x in each])
    b = held.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    b = b.select("key", "part", (F.col("c") == F.col("main")).alias("large"), *[F.col(x).alias(x + "b") for x in each])
    # they link if (100 + percent) * items in one of them only <= (100 - percent) * (na + nb)
    may = lambda differ: (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))
    differ = sum((F.bit_count(F.col(f"w{i}a").bitwiseXOR(F.col(f"w{i}b"))) for i in range(1, WORDS)), F.bit_count(F.col("w0a").bitwiseXOR(F.col("w0b"))))
    fits = (F.col("ca") != F.col("cb")) & (F.col("large") | (F.col("va") < F.col("vb"))) & may(F.abs(F.col("na") - F.col("nb"))) & may(differ)
    fits &= F.array_min(F.array_intersect("keysa", "keysb")) == a["key"]  # in the first bucket that they share, not in each one
    return a.join(b, (a["key"] == b["key"]) & (a["part"] == b["part"]) & fits).select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"))
