"""Packing, tool calls, decontamination, toxicity, token counts, and the pipeline."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from amberline.llm import decontaminate, packing, tokencount, toolcalls, toxicity
from amberline.llm import text as X
from tests.llm.conftest import BASE, TEXTS

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
WORD_BPE = vocabularies.path("word_bpe_49k.json")


def ids_of(texts):
    tok = tokenizers.Tokenizer.from_file(WORD_BPE)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoding_is_the_tokenizers():
    texts = [*TEXTS, "Don't we'LL 's", "É×÷Ÿ ñandú", "a1b22 c...d''s", "x\x1cz", "hello <|endoftext|> world", "<|startoftext|>a<|ENDOFTEXT|>", "a < | b <| c", "ﬁ ſ İ", "naïve\r\n\tb", "''d'", "¼½ª"]
    data, off = X.rows_of(pa.array(texts))
    got, at = packing.encode_rows(data, off, WORD_BPE)
    assert [got[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == ids_of(texts)


def test_packing_places_every_piece(spark, scratch, docs):
    got = packing.pack(docs, scratch, WORD_BPE, 0, 128).collect()
    want = {}
    for i, ids in enumerate(ids_of(TEXTS)):
        ids = [*ids, 0]
        for k in range(0, len(ids), 128):
            own = np.array(ids[k : k + 128], "<u4")
            want[i, k // 128] = (k, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got if r.doc_id is not None} == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(docs.limit(0), scratch, WORD_BPE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(4000):
        s = min(2048, max(1, int(rng.lognormvariate(5.5 + seed / 3, 1))))
        counts[s] = counts.get(s, 0) + 1
    placed, bins = packing.plan(counts, 2048)
    used, ranks = {}, {}
    for s, low, high, first, each, base in placed:
        for r in range(low, high):
            ranks.setdefault(s, set()).add(r)
            used.setdefault(first + (r - low) // each, []).append((base + (r - low) % each * s, s))
    assert {s: set(range(n)) for s, n in counts.items()} == ranks and len(used) == bins
    for pieces in used.values():
        assert [p for p, _ in sorted(pieces)] == [0, *np.cumsum([s for _, s in sorted(pieces)])[:-1]]
        assert sum(s for _, s in pieces) <= 2048
    large = sum(n for s, n in counts.items() if s > 1024)
    assert bins <= max(large, -(-sum(s * n for s, n in counts.items()) // 2048)) * 1.06 + 1


def test_tool_calls(spark, scratch):
    schemas = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}
    calls = spark.createDataFrame(
        [(1, 0, "x", "add", '{"a": 1}', None), (1, 2, "y", "add", '{"a":2}', ["x", "gone"]), (1, 4, "z", "add", '{"a":"b","c":1}', ["y", "x"]), (2, 0, "p", "add", '{"a":1}', ["q"]), (2, 1, "q", "add", '{"a":1}', ["p"]),
         (3, 0, "n", "none", "{}", []), (3, 1, "j", "add", "{", []), (1, 9, "x", "add", '{"a": 9}', None), (4, 0, None, "add", "{}", None)],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 1, "x", "ré\n"), (1, 1, "x", "ré\n"), (1, 3, "y", None), (9, 9, "lost", "?")], "conv_id long, turn long, call_id string, content string")
    got = {r.call_id: r for r in toolcalls.link(calls, results, schemas, scratch).collect()}
    assert {k: (r.status, r.level) for k, r in got.items()} == {"x": ("linked", 0), "y": ("linked", 1), "z": ("invalid", 2), "p": ("cyclic", None), "q": ("cyclic", None), "n": ("invalid", 0), "j": ("invalid", 0), "lost": ("orphan", None)}
    assert (got["x"].n_calls, got["x"].n_results, got["y"].n_missing) == (2, 2, 1)
    assert got["x"].json == '{"arguments":{"a":1},"depends_on":[],"id":"x","level":0,"name":"add","result":"ré\\n"}'
    assert json.loads(got["z"].json)["arguments"] == {"a": "b", "c": 1} and "not integer" in got["z"].errors
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas, scratch).count() == 0


def test_levels_of_long_chains_and_graphs(spark, scratch):
    n = 40
    waits = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(n)}
    rng = random.Random(3)
    graph = {f"g{i}": sorted({f"g{rng.randrange(i)}" for _ in range(rng.randrange(3))}) if i else [] for i in range(25)}
    ring = {"r0": ["r2"], "r1": ["r0", "g1"], "r2": ["r1"], "behind": ["r0"], "both": ["behind", "g3"], "self": ["self"]}

    def found(waits):
        before = scratch.count
        calls = spark.createDataFrame([(c,) for c in waits], "call_id string")
        edges = spark.createDataFrame([(c, d) for c, ds in waits.items() for d in ds], "call_id string, dep string")
        got = toolcalls.levels(calls, edges, scratch).collect()
        return {r.call_id: r.level for r in got}, len(got), scratch.count - before

    got, rows, saved = found(waits)
    assert got == {f"c{i}": i for i in range(n)} and rows == n and saved < 12  # rounds are log2 of the depth
    want = {}
    for c, ds in graph.items():
        want[c] = max((want[d] + 1 for d in ds), default=0)
    got, rows, _ = found(graph | ring)
    assert got == want and rows == len(want)


def test_decontamination_against_brute_force(spark, docs):
    items = [(1, " ".join(f"Shared{i}" for i in range(5, 30))), (2, "one two"), (3, BASE[50:200]), (4, "..."), (5, None), (6, "日本語"), (11, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = [(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    for block in (1 << 20, 100):  # one pass, several passes
        got = decontaminate.contamination(docs, bench, 10, block).collect()
        assert len(got) == docs.count()
        for r in got:
            w = words(TEXTS[r.doc_id] if r.doc_id is not None else BASE)
            hit, named = set(), set()
            for i, win in wins:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        named.add(str(i))
            sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(named), sha, bool(hit))
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.contaminated}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_toxicity_learns_and_scores_all(spark, scratch, docs):
    rng = random.Random(1)
    rows = []
    for i in range(500):
        words = [rng.choice(["tree", "house", "river", "cloud", "stone", "paper"]) + rng.choice("abc") for _ in range(30)]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(30)] = rng.choice(["idiot", "zorgle", "moron"])
        rows.append((1000 + i, " ".join(words), int(toxic)))
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = known.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    both = docs.select("doc_id", "text").unionByName(known.select("doc_id", "text"))
    got = toxicity.toxicity(both, labels, scratch).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth = {i: t for i, _, t in rows}
    apart = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in apart) >= 0.97 * len(apart)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0), scratch).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels, scratch).count() == 0


def test_toxicity_features_are_of_the_text_alone():
    texts = ["you are here", "idiot", "tree " * 14 + "idiot", "you", "", "no idiot no", "aa", "ab", "x", "xx 1", "a", "1", "b", "a@", "b", "tree " * 5 + "you " + "tree " * 4 + "idiot x", "idiot " + "x " * 5 + "you"]
    lexicon = [(np.zeros(0, np.uint64), np.zeros(0))] * len(toxicity.KINDS)
    of = lambda t: toxicity.features(*X.rows_of(pa.array(t)), lexicon)
    assert (of(texts) == np.concatenate([of([t]) for t in texts])).all()
    near = toxicity.FEATURES.index("near_second")
    assert (of(texts)[:, near] > 0).nonzero()[0].tolist() == [15]  # five words to each side, not six


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    s = rng.standard_normal(300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s))).astype(float)
    at, value = toxicity.fit_isotonic(s, y)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all() and abs(np.interp(s, at, value).mean() - y.mean()) < 0.02


def _unigram(vocab):
    low = min(s for _, s in vocab)
    tok = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", low)] + vocab, 0, False))
    pre = tokenizers.pre_tokenizers
    tok.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.Metaspace(prepend_scheme="always")])
    return tok


def test_token_counts_are_the_tokenizers(spark, docs):
    vocab = tokencount.unigram_vocabulary(vocabularies.path("piece_bpe_32k.model"))
    ref = _unigram([(p, s) for p, s in vocab if tokencount.MARK not in p[1:]])
    got = tokencount.token_counts(docs, vocab).collect()
    assert len(got) == docs.count()
    for r in got:
        t = TEXTS[r.doc_id] if r.doc_id is not None else BASE
        assert r.n_tokens == len(ref.encode(t or "").ids) and r.n_words == len((t or "").split())
    assert tokencount.token_counts(docs.limit(0), vocab).count() == 0


def test_ties_of_random_vocabularies():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc▁" if i == 0 else "abc") for i in range(rng.randint(1, 4))) for _ in range(10)}
        vocab = [(p, -float(rng.randint(1, 4))) for p in sorted(pieces)]
        ref, own = _unigram(vocab), tokencount.Counter(vocab)
        for _ in range(25):
            w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
            assert own.count(tokencount.MARK + w) == len(ref.encode(w).ids)


def test_pipeline_stages_keep_the_columns_and_the_clean(spark, tmp_path, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs.select("doc_id", "text").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).where("doc_id is not null")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "shared7 shared8 shared9 shared10 shared11 shared12 shared13 shared14 shared15 shared16")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, cur, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        cur = spark.read.parquet(str(tmp_path / f"stage{i}"))
    left = {r.doc_id: r for r in cur.collect()}
    assert 3 not in left and {5, 6, 8, 11, 12}.issubset(left) and left[0].text == BASE and left[1].text == ""
    assert all(r.text is None or r.n_chars == len(r.text) for r in left.values())
    packed = pipeline.STAGES[-1][1](spark, cur, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(left)
