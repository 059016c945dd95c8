"""Encoding of a corpus with a public byte-level BPE vocabulary through a minimal acyclic transducer.

One pass counts the corpus's words (the tokenizer's pre-tokens). The most frequent ones are compiled into a minimal
acyclic automaton whose suffixes are shared; its arcs count the words they pass over, so a walk yields a word's number
and with it the word's ids. The arrays are written once to the shared folder and memory-mapped by every task. The
second pass looks all distinct words of a batch up at once and merges unseen words exactly. Which words are in the
lexicon changes only the speed, never an id.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.durable import hadoop_path, scratch

#: Fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The lexicon's bound: words compiled at most.
LEXICON_WORDS = 65_536

_cache: dict = {}


def parsed(vocabulary: bytes) -> dict[bytes, int]:
    """Byte strings and ids of a vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary at ``path``."""
    with open(path, "rb") as f:
        return parsed(f.read())


def _ranks(shared: Broadcast) -> dict[bytes, int]:
    """The vocabulary that travels with the job, parsed once per process."""
    key = hash(shared.value)
    if key not in _cache:
        _cache[key] = parsed(shared.value)
    return _cache[key]


def _splitter():
    if "pattern" not in _cache:
        import regex

        _cache["pattern"] = regex.compile(PATTERN)
    return _cache["pattern"]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by byte-pair merging: the adjacent pair of lowest rank first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 512:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        best = min(pairs)
        if best == 1 << 60:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked neighbours, for very long words."""
    import heapq

    n = len(parts)
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[parts[i] + parts[i + 1]], i, parts[i], parts[i + 1]) for i in range(n - 1) if parts[i] + parts[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for k in (prev[i], i):
            if k >= 0 and nxt[k] < n and parts[k] + parts[nxt[k]] in ranks:
                heapq.heappush(heap, (ranks[parts[k] + parts[nxt[k]]], k, parts[k], parts[nxt[k]]))
    return [ranks[p] for p, ok in zip(parts, alive) if ok]


class Transducer:
    """A minimal acyclic automaton over bytes that numbers its words in sorted order, and the words' ids."""

    ARRAYS = ("arc", "target", "skip", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """``words`` distinct and sorted. States are made from the longest common prefix of neighbours downwards; a
        finished state is replaced by an equal one (same finality, same arcs) if there is any."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # (final, arcs [byte, target]) of the current word's prefix
        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            while len(path) > common + 1:
                child = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], child))
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
        while len(path) > 1:
            child = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], child))
        root = freeze(path[0])
        below = np.zeros(len(states), np.int64)  # words from a state on; children come before parents
        arc, target, skip = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for byte, t in arcs:
                arc.append(s * 256 + byte)
                target.append(t)
                skip.append(n)
                n += int(below[t])
            below[s] = n
        order = np.argsort(np.array(arc, np.int64), kind="stable")
        a = {k: np.array(v, np.int64)[order] for k, v in (("arc", arc), ("target", target), ("skip", skip))}
        a["final"] = np.array([f for f, _ in states] or [False])
        a["start"] = np.cumsum([0, *map(len, ids)])
        a["ids"] = np.array([*chain.from_iterable(ids), root], np.int32)  # the root is kept behind the ids
        return cls(a)

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for name in self.ARRAYS:
            np.save(f"{folder}/{name}.npy", self.arrays[name])

    @classmethod
    def load(cls, folder: str) -> Transducer:
        return cls({name: np.load(f"{folder}/{name}.npy", mmap_mode="r") for name in cls.ARRAYS})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it isn't in the lexicon; all words walk together, a byte at a time."""
        a, n = self.arrays, len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(a["arc"]):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        active, state, number = np.arange(n), np.full(n, int(a["ids"][-1]), np.int64), np.zeros(n, np.int64)
        at = 0
        while len(active):
            ended = lengths[active] == at
            done = active[ended]
            good = done[a["final"][state[done]]]
            out[good] = number[good]
            active = active[~ended]
            key = state[active] * 256 + flat[starts[active] + at]
            place = np.minimum(np.searchsorted(a["arc"], key), len(a["arc"]) - 1)
            hit = a["arc"][place] == key
            active, place = active[hit], place[hit]
            number[active] += a["skip"][place]
            state[active] = a["target"][place]
            at += 1
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = _splitter().findall
    for b in batches:
        counts = Counter(chain.from_iterable(split(t) for t in b.column("text").to_pylist() if t))
        for k in [w for w in counts if len(w) > 64]:
            del counts[k]  # the lexicon is for short words; longer ones are merged exactly
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each pre-token of at most 64 characters stands in the corpus; pre-aggregated per batch."""
    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> str | Broadcast:
    """Compile the corpus's most frequent words (``words`` at most, the smaller word first on ties; only they reach the
    driver) and return the folder of the memory-mapped arrays below the shared folder. Where that is not a mounted file
    system, the arrays (bounded by ``words``) are broadcast instead."""
    top = word_counts(df, text).where("n > 1").orderBy(F.desc("n"), "word").limit(words)
    chosen = sorted(r.word.encode() for r in top.collect())
    ranks = ranks_of(vocabulary)
    lexicon = Transducer.build(chosen, [merge_word(w, ranks) for w in chosen])
    place, _ = hadoop_path(df.sparkSession, scratch(df.sparkSession, "p7-lexicon"))
    if place.toUri().getScheme() != "file":
        return df.sparkSession.sparkContext.broadcast(lexicon.arrays)
    lexicon.save(place.toUri().getPath())
    return place.toUri().getPath()


def _encode(compiled: str | Broadcast, vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Transducer.load(compiled) if isinstance(compiled, str) else Transducer(compiled.value)
        ranks, split = _ranks(vocabulary), _splitter().findall
        known_start, known_ids = np.asarray(lexicon.arrays["start"]), np.asarray(lexicon.arrays["ids"])
        for b in batches:
            pieces = [split(t) if t else [] for t in b.column("text").to_pylist()]
            counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
            codes, uniques = pd.factorize(np.fromiter(chain.from_iterable(pieces), object, int(counts.sum())))
            words = [u.encode() for u in uniques]
            number = lexicon.numbers(words)
            unseen = np.flatnonzero(number < 0)
            merged = [merge_word(words[i], ranks) for i in unseen]
            # one id table for the batch: the lexicon's, then the unseen words'
            table = np.concatenate([known_ids, np.fromiter(chain.from_iterable(merged), np.int32)])
            start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            seen = number >= 0
            start[seen] = known_start[number[seen]]
            length[seen] = known_start[number[seen] + 1] - start[seen]
            length[unseen] = [*map(len, merged)]
            start[unseen] = len(known_ids) + np.cumsum(length[unseen]) - length[unseen]
            of_word = length[codes]
            ends = np.concatenate([[0], np.cumsum(of_word)])
            flat = table[np.repeat(start[codes] - ends[:-1], of_word) + np.arange(ends[-1])] if len(codes) else np.empty(0, np.int32)
            offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))], ["id", "ids"])

    return run


def encode(df: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon: str | Broadcast | None = None) -> DataFrame:
    """``row_id`` and ids (array<int>) of every row; null and empty texts have no ids (an empty list). Special tokens'
    strings are ordinary text. Null ids and equal rows come out as they are. ``lexicon``: from
    ``compile_lexicon``, made from ``df`` itself if none is given."""
    kind = df.schema[row_id].dataType.simpleString()
    lexicon = lexicon or compile_lexicon(df, text, vocabulary)
    with open(vocabulary, "rb") as f:  # bounded by the vocabulary; executors need no copy of the file
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_encode(lexicon, shared), f"id {kind}, ids array<int>")
    return rows.select(F.col("id").alias(row_id), "ids")
