"""Token counts by a count-only Viterbi over a unigram vocabulary (operator 10).

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character;
dynamic programming carries, for each end, the best score and the number of pieces of
the path that has it, and no path itself. Ties are the tokenizer's: candidates come by
ascending start, a later one must be strictly better, an unknown character costs the
least score less 10 where no single-character piece begins, and unknown characters in a
row are one piece.

White space parts words and marks their beginnings (metaspace), so no piece spans two
words; each distinct word is counted once a worker, and a text's count is a sum over
its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from amberline.llm import text as X

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Distinct words a worker remembers; beyond, it starts anew.
REMEMBERED = 1_000_000

_state: dict = {}


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file, in id order.

    The file's scores rank its pieces; as log-probabilities of a unigram model the
    score of rank r is -log(r + 2), the Zipf law's, less the log of the pieces' number.
    """
    import math

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(p, -math.log(r + 2) - math.log(len(pieces))) for r, p in enumerate(pieces)]


class Counter:
    """Counts pieces of words; vocab: (piece, score), no piece with MARK after its first character."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        """The number of pieces of the best path through ``word``."""
        n = len(word)
        best, pieces, unknown, reached = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        reached[0] = True
        at = 0

        def close(end: int) -> None:
            """The unknown character that ends here, after all pieces that do (its start is the last)."""
            if not single and reached[end - 1]:
                score = self.unknown + best[end - 1]
                if not reached[end] or score > best[end]:
                    reached[end], best[end], unknown[end] = True, score, True
                    pieces[end] = pieces[end - 1] + (not unknown[end - 1])

        single = False
        for last, (length, value) in self.automaton.iter(word) if len(self.automaton) else ():
            end = last + 1
            while at < end:  # ends without a piece
                if at:
                    close(at)
                at += 1
                single = False
            single = single or length == 1
            start = end - length
            if reached[start]:
                score = value + best[start]
                if not reached[end] or score > best[end]:
                    reached[end], best[end], pieces[end], unknown[end] = True, score, pieces[start] + 1, False
        while at <= n:
            if at:
                close(at)
            at += 1
            single = False
        return pieces[n]


def _counter(shared) -> tuple[Counter, dict]:
    """The counter of a broadcast vocabulary and its remembered words, once a worker."""
    vocab = shared.value
    key = (len(vocab), hash(tuple(vocab[:: max(1, len(vocab) // 64)])))
    if _state.get("key") != key:
        _state.update(key=key, counter=Counter(vocab), cache={})
    return _state["counter"], _state["cache"]


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Lead bytes of characters that Unicode counts as white space beyond ASCII; texts that hold one are split by Python.
_RARE = np.zeros(256, bool)
_RARE[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def _counts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    counter, cache = _counter(shared)

    def known(word: bytes) -> int:
        n = cache.get(word)
        if n is None:
            if len(cache) > REMEMBERED:
                cache.clear()
            n = cache[word] = counter.count(MARK + word.decode("utf-8", "replace"))
        return n

    for batch in batches:
        for a, b, data, off in X.slices(batch.column("text")):
            starts, ends, first = X.words(data, off, ~_SPACES)
            rows = b - a
            rare = np.add.reduceat(np.append(_RARE[data], False).astype(np.int64), np.minimum(off[:-1], len(data))) * (np.diff(off) > 0)
            row = np.repeat(np.arange(rows), np.diff(first))
            _, some, inverse = np.unique(X.hash_words(data, starts, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            each = np.array([known(raw[i:j]) for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], np.int64)
            out = np.bincount(row, each[inverse] if len(each) else None, rows).astype(np.int64)
            for r in np.flatnonzero(rare):
                out[r] = sum(known(w.encode()) for w in raw[off[r] : off[r + 1]].decode("utf-8", "replace").split())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(first) if not rare.any() else _word_counts(raw, off, first, rare)), pa.array(out)], ["doc_id", "n_words", "n_tokens"])


def _word_counts(raw: bytes, off: np.ndarray, first: np.ndarray, rare: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    for r in np.flatnonzero(rare):
        n[r] = len(raw[off[r] : off[r + 1]].decode("utf-8", "replace").split())
    return n


def token_counts(docs: DataFrame, vocab: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_words, n_tokens), one row per row of ``docs``: pieces of each whole text.

    Words are parted by Unicode white space, each begins with the mark. Null and empty
    texts have none. An empty vocabulary makes every word one unknown piece. A null doc_id stays null; other
    columns are ignored.
    """
    if any(MARK in p[1:] for p, _ in vocab):
        vocab = [(p, s) for p, s in vocab if MARK not in p[1:]]  # they match in no word
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # a tokenizer's vocabulary, of fixed size
    return docs.select("doc_id", "text").mapInArrow(partial(_counts, shared=shared), "doc_id long, n_words long, n_tokens long")
