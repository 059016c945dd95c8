"""Exactly-once by exact quotient hash tables.

An identifier is brought to a fixed width, permuted by an invertible mixing network, and split into a quotient (its first
word: the upper bits choose the shard, the lower ones the home slot) and a remainder. A slot stores the remainder and how
far it lies from its home; the quotient's bits that choose the home are not stored, the place gives them back. Because the
permutation is invertible, equal quotient and remainder mean equal identifiers: there are no false matches, whatever the
number of identifiers. Identifiers longer than the fixed width keep their tail beside the remainder, so they are exact as well.

Spark partitions the work: every input batch first inserts its identifiers into a small table of its own, so that a
hot identifier sends one row per batch to its shard; the shards then insert the survivors in order of row id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
WIDTH = 8 * WORDS
ROUNDS = 2
#: Surrounding characters that don't belong to an identifier.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f\x{200B}\x{FEFF}]"


def identifier(col: Column | str) -> Column:
    """An identifier without surrounding white space and without regard to case; null where nothing is left."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", ""))
    return F.when(bare != "", bare)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_key(words: np.ndarray, skip: int, round_no: int) -> np.ndarray:
    acc = np.full(len(words), 0x9E3779B97F4A7C15 + round_no * WORDS + skip, np.uint64)
    for j in range(words.shape[1]):
        if j != skip:
            acc = _mix(acc ^ words[:, j])
    return acc


def permute(words: np.ndarray) -> np.ndarray:
    """An unbalanced Feistel network over the words of each identifier: each step xors one word with a hash of the others."""
    words = words.copy()
    for r in range(ROUNDS):
        for j in range(words.shape[1]):
            words[:, j] ^= _round_key(words, j, r)
    return words


def unpermute(words: np.ndarray) -> np.ndarray:
    """The inverse of ``permute``."""
    words = words.copy()
    for r in reversed(range(ROUNDS)):
        for j in reversed(range(words.shape[1])):
            words[:, j] ^= _round_key(words, j, r)
    return words


def fixed_width(ids: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The first ``WIDTH`` bytes of each identifier as words, and what lies beyond. A terminating byte keeps
    identifiers apart that differ only in trailing zero bytes."""
    closed = [x + b"\x01" for x in ids]
    head = np.array([x[:WIDTH] for x in closed], f"S{WIDTH}")
    return head.view(np.uint64).reshape(-1, WORDS).copy() if len(ids) else np.empty((0, WORDS), np.uint64), [x[WIDTH:] for x in closed]


class QuotientTable:
    """Open addressing by quotient. A slot holds the complete remainder (what the first word has above the home's bits, the other
    words, and the tail's number) and its distance from the home. It grows with what is inserted."""

    def __init__(self, words: int = WORDS + 1, bits: int = 10):
        self.words, self.n = words, 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.rest = np.zeros((1 << bits, self.words), np.uint64)
        self.far = np.zeros(1 << bits, np.int64)
        self.used = np.zeros(1 << bits, bool)

    def _split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home slots and remainders."""
        rest = keys.copy()
        rest[:, 0] >>= np.uint64(self.bits)
        return (keys[:, 0] & np.uint64((1 << self.bits) - 1)).astype(np.int64), rest

    def keys(self) -> np.ndarray:
        """All keys, put together from places and remainders."""
        slot = np.flatnonzero(self.used)
        out = self.rest[slot]
        out[:, 0] = out[:, 0] << np.uint64(self.bits) | ((slot - self.far[slot]) & (len(self.used) - 1)).astype(np.uint64)
        return out

    def _grow(self, more: int) -> None:
        if (self.n + more) * 5 <= len(self.used) * 3:
            return
        old, bits = self.keys(), max(self.bits + 1, int(np.ceil(np.log2((self.n + more) * 2 + 1))))
        self._clear(bits)
        self._insert(old)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Insert each key once, in the given order; True where it wasn't there before."""
        self._grow(len(keys))
        return self._insert(keys)

    def _insert(self, keys: np.ndarray) -> np.ndarray:
        home, rest = self._split(keys)
        fresh, far, mask = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), len(self.used) - 1
        todo = np.arange(len(keys))
        while len(todo):
            slot = (home[todo] + far[todo]) & mask
            empty = ~self.used[slot]
            if empty.any():  # the first of those that meet in an empty slot takes it
                claim, first = np.unique(slot[empty], return_index=True)
                winners = todo[empty][first]
                self.rest[claim], self.far[claim], self.used[claim] = rest[winners], far[winners], True
                fresh[winners] = True
                self.n += len(winners)
            same = (self.far[slot] == far[todo]) & (self.rest[slot] == rest[todo]).all(1)
            todo = todo[~same]
            far[todo] += 1
        return fresh


def _keys(ids: list[bytes], tails: dict[bytes, int]) -> np.ndarray:
    """Permuted words and, as the last word, the number of the tail in ``tails`` (0: none)."""
    words, rest = fixed_width(ids)
    last = np.array([tails.setdefault(t, len(tails) + 1) if t else 0 for t in rest], np.uint64)
    return np.hstack([permute(words), last[:, None]]) if len(ids) else np.empty((0, WORDS + 1), np.uint64)


def _local(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [x.encode() for x in b.column(0).to_pylist()], b.column(1)
            order = np.asarray(pa.compute.sort_indices(rows))
            keys = _keys([ids[i] for i in order], {})
            surplus = ~QuotientTable().insert(keys)
            # what is surplus already goes anywhere: it needs no table
            shard = np.where(surplus, np.arange(len(ids)) % shards, ((keys[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0).take(pa.array(order)), rows.take(pa.array(order)), pa.array(surplus)], ["shard", "identifier", "row_id", "surplus"])

    return run


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, tails = QuotientTable(), {}
    for b in batches:
        surplus = np.asarray(b.column("surplus").to_pylist(), bool)
        ids = b.column("identifier").filter(pa.array(~surplus)).to_pylist()
        surplus[~surplus] = ~table.insert(_keys([x.encode() for x in ids], tails))
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(surplus, pa.bool_())], ["row_id", "surplus"])


def exactly_once(df: DataFrame, identifier_col: Column | str, row_id: str, shards: int | None = None) -> DataFrame:
    """Mark the surplus deliveries of ``df``: columns ``row_id``, ``surplus``.

    Of the rows with one identifier all but the one with the smallest ``row_id`` are surplus. Rows whose identifier is
    null or blank don't come out here (nothing is known to repeat them; they are kept). Rows with a null ``row_id``
    sort last, so one is surplus wherever another row has its identifier. Equal rows (same identifier and row id)
    count one by one: all but one are surplus. An empty frame gives an empty result. Other columns are not read.
    """
    shards = shards or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ids = df.select(identifier(identifier_col).alias("identifier"), F.col(row_id).cast("string").alias("row_id")).where("identifier is not null")
    local = ids.mapInArrow(_local(shards), "shard int, identifier string, row_id string, surplus boolean")
    # the shard's number is its partition
    ranked = local.repartitionById(shards, "shard").sortWithinPartitions(F.asc_nulls_last("row_id")).select("identifier", "row_id", "surplus")
    return ranked.mapInArrow(_shard, "row_id string, surplus boolean")
