"""Evaluation texts leaking into training text, by q-gram lemma filtering.

Texts are words in lower case joined by single spaces. If a passage of L characters occurs with at most e edits, it
shares at least L - q + 1 - e*q of its q-grams with the corpus text, all within a diagonal band of width e. Shared
q-grams are counted in overlapping bands per (document, item); bands that reach the bound are verified by an alignment
confined to the band. The held-out items are the queries: they are run in blocks against all rows, so neither side is
cut, and only a block's q-gram table travels to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 16
MIN_WORDS = 12
EDITS = 1
#: Characters of items that make up a block: bounds what a task holds of the items (about 40 bytes a character).
BLOCK_CHARS = 400_000
FOUND = "id {id}, item string, doc_from bigint, doc_to bigint, item_from bigint, edits int, exact_words int"

_WORD = re.compile(r"\w+")
_MULTIPLIER = 0x9E3779B97F4A7C15
_FILTER_BITS = 22


def plain(text: str | None) -> str:
    """Words in lower case, each between single spaces."""
    words = _WORD.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A rolling hash of every run of ``q`` code points."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    n = len(codes) - q + 1
    h = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for k in range(q):
        h = h * np.uint64(_MULTIPLIER) + wide[k : k + n]
    return h ^ (h >> np.uint64(29))


class Items:
    """The q-gram table of a block of items: sorted hashes with item and position, and each item's bound."""

    def __init__(self, names: list[str], texts: list[str], q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS):
        self.q, self.edits, self.min_words = q, edits, min_words
        kept = [(n, plain(t)) for n, t in zip(names, texts)]
        kept = [(n, t) for n, t in kept if t.count(" ") > min_words]
        self.names, self.texts = [n for n, _ in kept], [_codes([t]) for _, t in kept]
        self.bounds = np.array([self._bound(t) for _, t in kept], np.int64)
        grams = [qgrams(c, q) for c in self.texts]
        lengths = [*map(len, grams)]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        item, pos = np.repeat(np.arange(len(grams)), lengths), np.concatenate([*map(np.arange, lengths), np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.pos = h[order], item[order].astype(np.int32), pos[order].astype(np.int32)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def _bound(self, text: str) -> int:
        """Shared q-grams of the item's shortest passage of ``min_words`` words with ``edits`` edits."""
        spaces = np.array([m.start() for m in re.finditer(" ", text)])
        shortest = int((spaces[self.min_words :] - spaces[: -self.min_words]).min()) + 1
        return max(1, shortest - self.q + 1 - self.edits * self.q)

    def shortest(self, item: int) -> int:
        """Characters of the item's shortest passage, less what edits may take off."""
        return int(self.bounds[item]) + self.q - 1 + self.edits * self.q - self.edits


def _bands(items: Items, codes: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, item, lowest diagonal) of the bands that reach their item's bound. ``codes``: all texts of a batch."""
    h = qgrams(codes, items.q)
    at = np.flatnonzero(items.filter[h >> np.uint64(64 - _FILTER_BITS)])
    lo, hi = np.searchsorted(items.hashes, h[at], "left"), np.searchsorted(items.hashes, h[at], "right")
    met = hi > lo
    at, lo, n = at[met], lo[met], (hi - lo)[met]
    doc = np.searchsorted(starts, at, "right") - 1
    # a document with fewer shared q-grams than any bound can't hold a passage
    least = int(items.bounds.min()) if len(items.bounds) else 1
    enough = np.bincount(doc, minlength=len(starts))[doc] >= least
    at, lo, n, doc = at[enough], lo[enough], n[enough], doc[enough]
    if not len(at):
        return []
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, of = items.item[entry].astype(np.int64), np.repeat(np.arange(len(at)), n)
    diagonal = items.pos[entry].astype(np.int64) - (at - starts[doc])[of]
    place = (at - starts[doc])[of]
    pair, pair_of = np.unique(doc[of] << 14 | item, return_inverse=True)
    # a shortest passage lies within one of the windows of twice its length that begin at every length; longer windows
    # (for very long texts) only let more through
    longest = int(np.diff(np.concatenate([starts, [len(codes)]])).max())
    reach = np.maximum(items.bounds + (items.q - 1) + items.edits * (items.q + 1), longest // 4000 + 1)
    window = place // reach[item]
    # with edits, a band spans two steps and begins at each step, so any range of ``edits`` diagonals lies within one
    step, shift = max(items.edits, 1), 1 << 25
    band = diagonal // step + shift
    keys = [(pair_of << 39) | ((w + 1) << 26) | k for w in (window, window - 1) for k in ((band, band - 1) if items.edits else (band,))]
    value, count = np.unique(np.concatenate(keys), return_counts=True)
    value = value[count >= items.bounds[pair[value >> 39] & 0x3FFF]]
    value = np.unique((value >> 39) << 26 | (value & ((1 << 26) - 1)))
    of_pair = pair[value >> 26]
    return list(zip((of_pair >> 14).tolist(), (of_pair & 0x3FFF).tolist(), (((value & ((1 << 26) - 1)) - shift) * step).tolist()))


def _merged(bands: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int, int]]:
    """Overlapping and touching bands of a document and item as one: (document, item, lowest diagonal, width)."""
    out: list[list[int]] = []
    for doc, item, lowest in sorted(bands):
        if out and out[-1][:2] == [doc, item] and lowest <= out[-1][2] + out[-1][3]:
            out[-1][3] = lowest + width - out[-1][2]
        else:
            out.append([doc, item, lowest, width])
    return [tuple(x) for x in out]


def align(doc: np.ndarray, item: np.ndarray, lowest: int, width: int, edits: int, seed: int, spaces: np.ndarray, least: int = 0) -> tuple[int, int, int, int, int]:
    """The longest passage within the band of ``width`` diagonals from ``lowest``: (document from, to, item from, edits,
    most whole words in one exact run). Exact runs are extended over at most ``edits`` edits, greedily the furthest first;
    not at all where the longest ``edits`` + 1 runs together don't make ``least`` characters."""
    runs: dict[int, tuple[np.ndarray, int, int]] = {}  # diagonal: first differing place from each place on
    best, exact = (0, 0, 0, 0), 0
    begins = []
    for d in range(lowest, lowest + width):
        a, b = max(0, -d), min(len(doc), len(item) - d)
        if b - a < 1:
            continue
        differs = np.flatnonzero(np.concatenate([doc[a:b] != item[a + d : b + d], [True]])) + a
        runs[d] = (differs, a, b)
        first = np.concatenate([[a], differs[:-1] + 1])
        long = differs - first >= seed
        if long.any():
            x, y = first[long], differs[long]
            begins += zip(x.tolist(), y.tolist(), [d] * len(x))
            exact = max(exact, int((np.searchsorted(spaces, y) - np.searchsorted(spaces, x)).max()) - 1)

    if sum(sorted((y - x for x, y, _ in begins), reverse=True)[: edits + 1]) + edits < least:
        return (*best, exact)

    def furthest(d: int, i: int) -> int:
        differs, a, b = runs[d]
        return int(differs[np.searchsorted(differs, i)]) if a <= i < b else i

    for x, y, d in begins:
        front, spent = {d: y}, 0
        while True:
            e, i = max(front.items(), key=lambda f: f[1])
            if i - x > best[1] - best[0]:
                best = (x, i, x + d, spent)
            if spent == edits:
                break
            nxt: dict[int, int] = {}
            for e, i in front.items():
                for e2, i2 in ((e, i + 1), (e - 1, i + 1), (e + 1, i)):
                    if e2 in runs and i2 <= runs[e2][2]:
                        nxt[e2] = max(nxt.get(e2, 0), furthest(e2, i2))
            if not nxt:
                break
            front, spent = nxt, spent + 1
    return (*best, exact)


def _search(shared, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for b in batches:
            texts = [plain(t) for t in b.column("text").to_pylist()]
            closed = [t + "\0" for t in texts]
            starts = np.cumsum([0, *map(len, closed)])[:-1]
            codes = _codes(closed)
            rows: dict[tuple[int, int], tuple] = {}
            space: dict[int, np.ndarray] = {}
            for doc, item, lowest, width in _merged(_bands(items, codes, starts), 2 * items.edits or 1):
                text = codes[starts[doc] : starts[doc] + len(texts[doc])]
                if doc not in space:
                    space[doc] = np.flatnonzero(text == 32)
                got = align(text, items.texts[item], lowest, width, items.edits, items.q, space[doc], items.shortest(item))
                old = rows.get((doc, item))
                if old is None or (got[1] - got[0], -got[0]) > (old[1] - old[0], -old[0]):
                    rows[doc, item] = (*got[:4], max(got[4], old[4] if old else 0))
                else:
                    rows[doc, item] = (*old[:4], max(got[4], old[4]))
            # a passage is verified if it is as long as the bound's and has the words
            good = [(k, v) for k, v in rows.items() if v[1] - v[0] >= items.shortest(k[1]) or v[4] >= items.min_words]
            cols = list(zip(*[v for _, v in good])) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array([k[0] for k, _ in good], pa.int64())), pa.array([items.names[k[1]] for k, _ in good], pa.string()), *(pa.array(list(c), pa.int64()) for c in cols[:3]), *(pa.array(list(c), pa.int32()) for c in cols[3:])],
                ["id", "item", "doc_from", "doc_to", "item_from", "edits", "exact_words"],
            )

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "example_id", item_text: str = "content", q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and item with a passage in common: ``row_id``, ``item_id``, doc_from and doc_to (of the longest
    passage, in the plain text), item_from, edits, exact_words (most words in a row that stand in a row in the item).

    A passage is as long as the item's shortest run of ``min_words`` words and has at most ``edits`` edits, or has
    ``min_words`` words in a row exactly. Null and empty texts and items of fewer words have none; an item given twice
    (same id) counts once per text; null ids are kept. The items are held-out sets of bounded size, read in blocks of
    ``BLOCK_CHARS`` characters; each block is one pass over the documents, without a shuffle.
    """
    spark = docs.sparkSession
    kind = docs.schema[row_id].dataType.simpleString()
    source = docs.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text"))
    out, names, texts = None, [], []

    def block() -> DataFrame:
        shared = spark.sparkContext.broadcast(Items(names, texts, q, edits, min_words))
        return source.mapInArrow(_search(shared, row_id), FOUND.format(id=kind))

    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).distinct().orderBy("item", "text")
    for r in wanted.toLocalIterator():
        if texts and (sum(map(len, texts)) + len(r.text) > BLOCK_CHARS or len(texts) >= 1 << 14):
            out, names, texts = block() if out is None else out.union(block()), [], []
        names.append(r.item)
        texts.append(r.text)
    out = block() if out is None else out.union(block())
    return out.select(F.col("id").alias(row_id), F.col("item").alias(item_id), "doc_from", "doc_to", "item_from", "edits", "exact_words")
