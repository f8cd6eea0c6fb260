"""Deduplicating operators against brute force on small tables."""

import hashlib
import math
import random

import numpy as np

from amberline.llm import embeddings, lines, minhash, substring, suffix
from amberline.llm.components import components
from amberline.llm.sql import SQL


def collect(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key]))


def reach(ids, linked):
    low = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components_of_chain_star_and_loop(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{j: 100 for j in range(101, 140)}, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def shingle_set(text, n):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def test_minhash_against_brute_force(spark, scratch, docs):
    rng = random.Random(3)
    more = []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        for k in range(3):
            own = list(words)
            for _ in range(k * len(own) // 18):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
            more.append((100 + 3 * i + k, " ".join(own)))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for n in (2, 5):
        sets = {i: shingle_set(t, n) for i, t in rows if i is not None}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        low = reach(sets, links)
        got = collect(minhash.near_duplicates(df, scratch, n, 80))
        assert len(got) == len(rows) and len(links) > 20
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_large_group_of_near_copies(spark, scratch):
    """Copies of copies: neighbours are close, the group's ends are not."""
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words[(i * 7) % 120] = f"e{i}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, scratch, 2, 80).collect()} == {0}


def test_empty_tables(spark, scratch, empty):
    assert minhash.near_duplicates(empty, scratch, 2).count() == 0
    assert substring.substring_dedup(empty, scratch).count() == 0
    assert suffix.suffix_dedup(empty, scratch).count() == 0
    assert lines.line_dedup(empty, scratch).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


def test_substring_against_brute_force(spark, scratch, docs):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = collect(substring.substring_dedup(one, scratch, 20))
    seen = set()
    for r, row in zip(got, collect(one), strict=True):
        w = (row.text or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert sum(r.n_removed for r in got) > 100
    assert substring.substring_dedup(docs, scratch).count() == docs.count()


def test_suffix_against_brute_force(spark, scratch, docs):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = collect(suffix.suffix_dedup(one, scratch, 50))
    first = {}
    for r, row in zip(got, collect(one), strict=True):
        b = (row.text or "").encode()
        gone = set()
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], row.doc_id) < row.doc_id:
                gone |= set(range(i, i + 50))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    assert sum(r.n_removed for r in got) > 1000
    assert suffix.suffix_dedup(docs, scratch).count() == docs.count()


def test_rows_that_share_a_doc_id(spark, scratch):
    """A row twice over stays in both copies; of two texts with one doc_id each loses its own repeats only."""
    word = lambda p, n: [f"{p}{i}" for i in range(n)]
    rows = [(1, word("a", 40)), (1, word("a", 40)), (2, word("b", 5) + word("a", 30)), (3, word("c", 25)), (3, word("d", 60) + word("a", 25)), (4, word("e", 90)), (5, word("f", 30) + word("e", 20))] + [(5, word("g", 22))] * 2
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    windows = [(tuple(w[s : s + 20]), (i, s)) for i, w in rows for s in range(len(w) - 19)]
    low = {g: min(p for h, p in windows if h == g) for g, _ in windows}
    want = []
    for i, w in rows:
        gone = {j for s in range(len(w) - 19) if low[tuple(w[s : s + 20])] < (i, s) for j in range(s, s + 20)}
        want.append((i, len(w), " ".join(x for j, x in enumerate(w) if j not in gone)))
    for parts in (1, 9):
        got = substring.substring_dedup(df.repartition(parts), scratch, 20).collect()
        assert sorted((r.doc_id, r.n_words, r.kept) for r in got) == sorted(want)
    texts = [(i, " ".join(w).encode()) for i, w in rows]
    first = {}
    for i, b in texts:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    want = []
    for i, b in texts:
        gone = {j for s in range(len(b) - 49) if first[b[s : s + 50]] < i for j in range(s, s + 50)}
        want.append((i, bytes(x for j, x in enumerate(b) if j not in gone)))
    for parts in (1, 9):
        got = suffix.suffix_dedup(df.repartition(parts), scratch, 50).collect()
        assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted(want)


def test_words_that_polynomial_hashes_confuse(spark, scratch):
    """Long words after the Thue-Morse pattern collide under every polynomial modulo 2**64; here they stay apart."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    tail = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df, scratch, 20).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df.where("doc_id > 2"), scratch, 2).collect()}
    assert got == {3: 3, 4: 4}


def test_divided_buckets_lose_no_link(spark, scratch):
    """Groups of texts that resemble each other, some linking and some not, beyond the size that is paired directly."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice((2, 6, 10, 14))):
            words[rng.randrange(120)] = f"e{rng.randrange(10_000)}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = {i: shingle_set(t, 2) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = reach(list(sets), links)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, scratch, 2, 80).collect()} == low
    assert len(set(low.values())) > 3 and links


def test_texts_that_only_resemble_each_other_are_not_paired_one_by_one(spark, scratch, monkeypatch):
    """pipeline, op5: of a bucket that stays divided, only pairs that link or nearly do come out of the join."""
    from amberline.llm.scratch import Scratch

    rng, save, pairs = random.Random(5), Scratch.save, []

    def saved(self, df):
        out = save(self, df)
        if df.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(0, 150, 3), 7):
            words[at] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    texts[149] = (149, texts[140][1].replace("b149", "end"))
    out = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), scratch, 2, 80).collect()
    sets = {i: shingle_set(t, 2) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in out} == reach(list(sets), links)
    assert max(pairs) < 10 * len(texts)  # of 11,175 pairs


def test_what_is_kept_and_shuffled_while_contents_are_fetched(spark, scratch, docs, monkeypatch):
    """F1, F2, op8: the keys of all bands are gone by then, and sets are made after the join that picks their documents."""
    from amberline.llm.scratch import Scratch

    kept, seen, save, drop = {}, [], Scratch.save, Scratch.drop

    def saved(self, df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if {"v", "sig", "x"} <= set(df.columns):
            seen.append(([c for c in kept.values() if "keys" in c], plan.splitlines()[0]))
        out = save(self, df)
        kept[out._amberline_path] = df.columns
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    monkeypatch.setattr(Scratch, "drop", lambda self, *dfs: (drop(self, *dfs), [kept.pop(x._amberline_path) for x in dfs]))
    lines.line_dedup(docs, scratch)
    minhash.near_duplicates(docs, scratch, 2)
    (wide, _), (_, top) = seen
    assert not wide and "MapInArrow" in top


def test_lines_against_brute_force(spark, scratch, docs):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    k, own = 8, []
    for row in collect(one):
        for pos, line in enumerate((row.text or "").split("\n") if row.text is not None else []):
            if line.strip(" \t\r"):
                own.append(((row.doc_id, pos), {line[i : i + k] for i in range(max(1, len(line) - k + 1))}))
    links = [(a, b) for i, (a, x) in enumerate(own) for b, y in own[:i] if 100 * len(x & y) >= 80 * len(x | y)]
    low = reach([a for a, _ in own], links)
    got = collect(lines.line_dedup(one, scratch))
    for r, row in zip(got, collect(one), strict=True):
        if row.text is None:
            assert r.text is None and r.n_lines == 0
            continue
        kept = [line for pos, line in enumerate(row.text.split("\n")) if low.get((row.doc_id, pos), (row.doc_id, pos)) == (row.doc_id, pos)]
        assert r.text == "\n".join(kept) and r.n_lines == len(row.text.split("\n")) and r.key == "x"
    assert sum(r.n_lines_removed for r in got) >= 5
    assert lines.line_dedup(docs, scratch).count() == docs.count()


def test_lines_at_the_limit_meet(spark):
    """Pairs of sets of 5 to 50 shingles at similarity 0.8: the share that no band meets or that differs too much."""
    from pyspark.sql import functions as F

    pairs = 20_000
    for union in (5, 10, 20, 50):
        own = union // 10 if union > 5 else 1  # what only one of the two has; of 5 all is one's
        each = spark.range(pairs * union, numPartitions=4).select(F.floor(F.col("id") / union).alias("pair"), (F.col("id") % union).alias("i"), F.xxhash64("id", F.lit(union)).alias("h"))
        sides = [each.where(F.col("i") >= (own if union > 5 else 0)), each.where(F.col("i") < union - own)]
        a, b = (lines.signatures(x.select(F.col("pair").alias("v"), "h")).select("v", F.col("sig").alias(f"s{i}"), F.col("keys").alias(f"k{i}")) for i, x in enumerate(sides))
        meets = F.exists(F.zip_with("k0", "k1", lambda x, y: x == y), lambda x: x)
        found = a.join(b, "v").where(meets & lines.close("s0", "s1")).count()
        assert pairs - found <= 1e-3 * pairs, (union, pairs - found)


def test_keys_are_shuffled_once(spark, scratch, monkeypatch):
    """op5: a bucket's bounds and members come from one shuffle of the keys."""
    import pytest

    from amberline.llm.buckets import link_buckets
    from amberline.llm.scratch import Scratch

    keyed, plans = scratch.save(spark.range(400).selectExpr("id % 90 as key", "id as v")), []

    def saved(self, df):
        assert df.count() and len(df.collect()) == 310
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(Scratch, "save", saved)
    with pytest.raises(InterruptedError):
        link_buckets([keyed], None, None, None, 80, scratch)
    assert "ReusedExchange" in plans[0]


def test_what_lines_keep_and_shuffle(spark, scratch, docs, monkeypatch):
    """op5: no table holds the keys of the bands; texts are shuffled whole and split after, and not sorted at the end."""
    from amberline.llm.scratch import Scratch

    save, columns, plans = Scratch.save, [], []

    def saved(self, df):
        columns.append(df.columns)
        if df.columns == ["v", "sig", "x"]:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", saved)
    out = lines.line_dedup(docs, scratch)
    assert out.count() == docs.count() and not any("keys" in c for c in columns[:5])
    assert len(plans) == 1 and plans[0].index("Generate explode(own") < plans[0].index("Join")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_doc_id(spark, scratch):
    """op5: near copies are found where rows of one doc_id differ in length and in what a place holds."""
    line = "the quick brown fox jumps over the lazy dog near the old river bank every single morning"
    rows = [(1, "short"), (1, f"other first line\nsecond of it\n{line}"), (2, f"{line}s"), (3, f"x\n{line}!")]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([*rows[:2], (2, ""), (3, "x")])


def test_a_row_holds_several_shingles(spark):
    """op5: 12 shingles of a line take 3 rows."""
    from pyspark.sql import functions as F

    text = spark.createDataFrame([(1, "abcdefghijklmnopqrs")], "v long, line string")
    assert lines.shingle_rows(text.select("v", F.encode("line", "UTF-16BE").alias("unit")), 8, ("v",)).count() == 3


def test_line_dedup_has_no_python_on_its_way(spark, scratch, docs):
    plan = lines.line_dedup(docs, scratch)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_embeddings_against_brute_force(spark, scratch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base, base + 0.3 * rng.standard_normal((40, 24)), base[:20] + 0.05 * rng.standard_normal((20, 24)), base[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None] + [0.0] * 22), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.array(v, float) for i, v in rows if i is not None and i not in (900, 901, 902, 903)}
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / math.sqrt(good[a] @ good[a]) / math.sqrt(good[b] @ good[b]) >= 0.9:
                links.append((a, b))
    low = reach([i for i, _ in rows if i is not None], links)
    got = collect(embeddings.near_duplicates(df, scratch, 0.9), "vec_id")
    assert len(got) == len(rows)
    for r in got[:-1]:
        assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in x for x in links), low[r.vec_id], low[r.vec_id] == r.vec_id)
    assert got[-1].n_links == 0 and got[-1].kept


def test_embedding_hot_bucket_is_split(spark, scratch, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    x = centre + 0.01 * rng.standard_normal((60, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "HOT", 16)
    got = embeddings.near_duplicates(df, scratch, 0.9).collect()
    assert {r.n_links for r in got} == {59} and {r.component_id for r in got} == {0}


def test_recall_of_tables():
    for n in (100, 10_000, 10_000_000):
        k, tables = embeddings.shape(n, 0.9)
        assert (1 - embeddings.meets(math.sqrt(0.2)) ** k) ** tables <= 1e-3
    assert set(SQL) >= {"op1_embedding_near_dedup", "op4_benchmark_decontamination", "op6_substring_dedup", "op8_minhash_near_dedup"}
