"""Words and word shingles, shared by the operators on near-duplicates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 3
#: Bits of a word's number within the integer that stands for a run.
RUN_BITS = 63 // RUN
MIN_WORDS = 20
THRESHOLD = 0.5
#: Texts of which min-hash values are worked out at once.
TEXTS = 64
#: Pairs of texts whose similarity is worked out at once.
PAIRS = 1024


_LINK = re.compile(r"https?://\S*")
_WORD = re.compile(r"\w+")
#: Of the characters of Latin-1 those of words, all others as spaces.
_LATIN = bytes(i if _WORD.match(chr(i)) else 32 for i in range(256))


def words_of(*fields: str | None) -> list[str]:
    """The words of the fields: null as empty, lower case, links removed, words being runs of letters, digits and underscores."""
    text = " ".join([x or "" for x in fields]).lower()
    if "://" in text:
        text = _LINK.sub(" ", text)
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def normal_texts(batch: pa.RecordBatch, text_cols: tuple[str, ...], least: int = MIN_WORDS) -> tuple[np.ndarray, list[str]]:
    """Row numbers and normal texts (words joined by single spaces) of the rows with ``least`` words or more."""
    rows, norms = [], []
    for i, fields in enumerate(zip(*[batch.column(c).to_pylist() for c in text_cols])):
        words = words_of(*fields)
        if len(words) >= least:
            rows.append(i)
            norms.append(" ".join(words))
    return np.array(rows, np.int64), norms


def text_classes(norms: list[str], seed: int = 0) -> np.ndarray:
    """The class of rows with the same words (64 bits). Classes steer where rows meet; pairs of classes are verified on the
    words, rows of one class by a second class with another seed."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in norms), np.uint64, len(norms)).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(norms: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word runs of the texts, one after the other, and the number of each text (texts of fewer than
    ``run`` words have none). A run's hash doesn't depend on its text."""
    words = pa.compute.split_pattern(norms, " ")
    counts = np.diff(np.asarray(words.offsets))
    coded = words.flatten().dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
    if len(h) < run:
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    acc = np.zeros(len(h) - run + 1, np.uint64)
    for k in range(run):
        acc = mix(acc + h[k : len(h) - run + 1 + k])
    return acc[_inside(counts, run)[: len(acc)]], np.maximum(counts - run + 1, 0)


def _inside(counts: np.ndarray, run: int) -> np.ndarray:
    """Of texts with so many words, one after the other: whether a run begins at a word."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return place <= np.repeat(counts, counts) - run


def min_hashes(shingles: np.ndarray, counts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` min-hash values (uint64) of each text's shingles; every text must have one at least."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.empty((len(counts), n), np.uint64)
    for at in range(0, len(counts), TEXTS):  # few enough that the values stay near the processor
        own = slice(at, at + TEXTS)
        first = starts[at]
        values = np.multiply.outer(a, shingles[first : ends[own][-1]])
        values += b[:, None]
        out[own] = np.minimum.reduceat(values, starts[own] - first, axis=1).T
    return out


def nibble_sketch(mins: np.ndarray) -> list[np.ndarray]:
    """Min-hash values as nibbles of bigints, sixteen in each; two texts agree in a nibble with probability J + (1-J)/16."""
    nibbles = mix(mins) >> np.uint64(60)
    place = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return [(nibbles[:, k : k + 16] << place).sum(1, dtype=np.uint64).view(np.int64) for k in range(0, mins.shape[1], 16)]


def sketch_agreement(a: list[Column], b: list[Column]) -> Column:
    """The number of equal nibbles of two sketches."""
    differ = F.lit(0)
    for u, v in zip(a, b):
        x = u.bitwiseXOR(v)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    return F.lit(16 * len(a)) - differ


def agreement(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``sketch_agreement`` of arrays."""
    same = np.full(len(a[0]), 16 * len(a), np.int64)
    for u, v in zip(a, b):
        x = (u ^ v).view(np.uint64)
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        same -= np.bitwise_count(x & np.uint64(0x1111111111111111))
    return same


def runs_of(norm: str, run: int = RUN) -> set[tuple[str, ...]]:
    """The distinct word runs of a normal text."""
    words = norm.split(" ")
    return set(zip(*[words[k:] for k in range(run)]))


def similarities(a: list[str] | pa.Array, b: list[str] | pa.Array) -> list[float]:
    """Exact Jaccard similarity of the distinct word runs of each two normal texts; 0 where either has none."""
    return [x for at in range(0, len(a), PAIRS) for x in _similarities(pa.array(a[at : at + PAIRS]), pa.array(b[at : at + PAIRS]))]


def _similarities(a: pa.Array, b: pa.Array) -> list[float]:
    texts = pa.concat_arrays([a, b]).dictionary_encode()  # a text is often in several pairs
    left, right = texts.indices.to_numpy().astype(np.int64).reshape(2, -1)
    words = pa.compute.split_pattern(texts.dictionary, " ")
    counts = np.diff(np.asarray(words.offsets))
    coded = words.flatten().dictionary_encode()
    if len(coded.dictionary) >> RUN_BITS:  # more words than numbers: told by the words themselves
        sets = [(runs_of(x), runs_of(y)) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return [len(x & y) / len(x | y) if x & y else 0.0 for x, y in sets]
    numbers = coded.indices.to_numpy().astype(np.int64)
    acc = np.zeros(max(len(numbers) - RUN + 1, 0), np.int64)  # a run is one integer of its words' numbers
    for k in range(RUN):
        acc = acc << RUN_BITS | numbers[k : k + len(acc)]
    kinds, runs = np.unique(acc[_inside(counts, RUN)[: len(acc)]], return_inverse=True)
    # the distinct runs of each text, one text after the other; then those of both texts of each pair, equal ones side by side
    held = np.sort(np.repeat(np.arange(len(counts)), np.maximum(counts - RUN + 1, 0)) * (len(kinds) + 1) + runs)
    owner, run = np.divmod(held[np.diff(held, prepend=-1) != 0], len(kinds) + 1)
    sizes = np.bincount(owner, minlength=len(counts))
    text, pair = np.concatenate([left, right]), np.tile(np.arange(len(a)), 2)
    n = sizes[text]
    place = np.arange(n.sum()) + np.repeat(np.cumsum(sizes)[text] - np.cumsum(n), n)
    both = np.sort(np.repeat(pair, n) * (len(kinds) + 1) + run[place])
    common = np.bincount(both[1:][np.diff(both) == 0] // (len(kinds) + 1), minlength=len(a))
    return (common / np.maximum(sizes[left] + sizes[right] - common, 1)).tolist()


@F.arrow_udf(T.DoubleType())
def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact Jaccard similarity of the distinct word runs of two normal texts; 0 where either has none."""
    return pa.array(similarities(a, b), pa.float64())
