"""Deduplicating new batches against all history by multi-key sorted-neighbourhood runs.

Every text class gets ``PASSES`` sort keys, each a pair of min-hash values kept in their order (the first in the upper bits,
the second in the lower ones), so that records alike stand next to each other in some order. A delivery's keys are written as a
sorted run in key ranges (one bucket of a table each; a row holds many entries) and merged range by range with the persisted runs of earlier deliveries:
of each run only the windows around new records are compared, old records are never compared with each other again and
their contents are read only where a window names them. Runs are compacted when there are more than ``MAX_RUNS``.

The window of a record holds all records with an equal key, and ``WINDOW`` records on either side of those as far as they have
the same first value. Ranges are cut between first values only, so no window crosses the edge of a range. Copies of a text are
one class and stand in a window once; what a window holds is thinned by a sketch and verified by the exact similarity.

Recall at similarity J is at least 1 - (1 - J^2)^PASSES: 99.0 % at 0.5, 99.9 % at 0.6, and more where fewer than ``WINDOW`` records
share the first value (all of them are compared): up to 1 - (1 - J)^PASSES, 99.998 % at 0.5. Equal texts are always found.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import shingles as S
from postloom.operators.durable import kept, materialize, measured, remove, scratch, shared_dir
from postloom.operators.quotient import identifier

PASSES = 16
#: Records on either side of the equal keys that are compared, and the bits of a key that hold the second value.
WINDOW, SECOND = 32, 28
#: Pairs compared at once: few enough that their sketches stay near the processor.
CHUNK = 1 << 14
MAX_RUNS = 4
#: Words of the sketch (16 nibbles each) and the nibbles that must agree: a pair at 0.5 agrees in 25 of 48 (deviation 3.5; 0.02 % are below 13), one at 0.15 in 10.
SKETCH, MIN_AGREE = 3, 13
SKETCHES = [f"sketch{k}" for k in range(1, SKETCH + 1)]
#: A row of a run: entries (key, class, sketch) of a key range in the order of the keys, as one array of 64-bit numbers, and the first key.
RUN = "range int, low bigint, entries binary"
#: Rows whose entries are laid out at once, and the entries of one row of a run.
LAID, BLOCK = 1 << 16, 1 << 14
SETTLED = "gid bigint, row_id string, i1 bigint, i2 bigint, cid bigint, kept_gid bigint"
#: Rows of a lookup table that may be broadcast (at most 40 bytes each); a larger one is shuffled. All of them come from one delivery
#: or its candidate pairs, whose rows are counted when they are written.
BROADCAST_ROWS = 1_000_000
#: Rows of a round and links between classes (at most 49 and 16 bytes each, counted when they are written) up to which the further
#: rounds are one task's: each round of tables is a plan of some twenty stages, which costs the driver more than the rows cost a task.
LAST_ROWS, LAST_LINKS = 1 << 19, 1 << 21
NONE = np.iinfo(np.int64).max


def sort_key(first: np.ndarray, second: np.ndarray, number: int) -> np.ndarray:
    """The key of one pass (bigint): sorts by the first value, then by the second."""
    low = np.uint64(SECOND)
    key = S.mix(first + np.uint64(number + 1)) >> low << low | S.mix(second) >> (np.uint64(64) - low)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def windows(new: np.ndarray, old: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``new`` and in ``old`` (sorted keys) of the records in each new one's window, in pieces."""
    first, group = new >> SECOND, old >> SECOND
    lo = np.maximum(np.searchsorted(group, first, "left"), np.searchsorted(old, new, "left") - WINDOW)
    hi = np.minimum(np.searchsorted(group, first, "right"), np.searchsorted(old, new, "right") + WINDOW)
    return _pieces(lo, hi)


def windows_within(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each two of ``keys`` (sorted) of which one stands in the window of the other, once each."""
    group, at = keys >> SECOND, np.arange(len(keys))
    equal = np.searchsorted(keys, keys, "right")
    # as far as the own window goes, and on to the last whose window comes down to here
    hi = np.maximum(equal + WINDOW, equal[np.minimum(at + WINDOW, len(keys) - 1)])
    return _pieces(at + 1, np.minimum(np.searchsorted(group, group, "right"), hi))


def _pieces(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place k with those from lo[k] up to hi[k], in pieces."""
    size = np.maximum(hi - lo, 0)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + CHUNK, "right")))
        n = size[at:stop]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(np.arange(at, stop), n), np.repeat(lo[at:stop], n) + within
        at = stop


def _entries(parts: list[bytes]) -> np.ndarray:
    """Keys, classes and sketches of all parts in the order of keys and classes, each entry once."""
    e = np.concatenate([np.frombuffer(x, np.int64).reshape(2 + SKETCH, -1) for x in parts], 1)
    e = e[:, np.lexsort((e[1], e[0]))]
    return e[:, np.append(True, (np.diff(e[0]) != 0) | (np.diff(e[1]) != 0))[: e.shape[1]]]


def _by_range(entries: np.ndarray, names: list[int]) -> pa.RecordBatch:
    """Entries as one row of each key range, which has the name of its number: ranges are cut by the upper 31 bits of the key, all
    of them of the first value."""
    number = ((entries[0] >> 33) + (1 << 30)) * len(names) >> 31
    order = np.argsort(number, kind="stable")
    number, entries = number[order], entries[:, order]
    cuts = [*np.flatnonzero(np.diff(number, prepend=-1)), len(number)]
    return pa.RecordBatch.from_arrays([pa.array([names[number[x]] for x in cuts[:-1]], pa.int32()), pa.array([entries[:, x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], ["range", "entries"])


def _lay_out(names: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes (cid, marks) as entries by range."""

    def laid(cids: list[np.ndarray], marks: list[bytes]) -> pa.RecordBatch:
        cid, at = np.unique(np.concatenate([*cids, np.empty(0, np.int64)]), return_index=True)
        own = np.frombuffer(b"".join(marks), np.int64).reshape(-1, PASSES + SKETCH)[at]  # copies are one before their keys are laid out
        return _by_range(np.stack([own[:, :PASSES].ravel(), *(np.repeat(x, PASSES) for x in (cid, *own[:, PASSES:].T))]), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, marks = [], []
        for b in batches:
            cids.append(b.column("cid").to_numpy())
            marks += b.column("marks").to_pylist()
            if len(marks) >= LAID:
                yield laid(cids, marks)
                cids, marks = [], []
        yield laid(cids, marks)

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a run from the entries of whole ranges."""
    parts: dict[int, list[bytes]] = {}
    for b in batches:
        for name, x in zip(b.column("range").to_pylist(), b.column("entries").to_pylist()):
            parts.setdefault(name, []).append(x)
    for name, own in parts.items():
        e = _entries(own)
        for at in range(0, e.shape[1], BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array(e[0, at : at + 1]), pa.array([e[:, at : at + BLOCK].tobytes()], pa.binary())], ["range", "low", "entries"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a run, a row each."""
    for b in batches:
        for name, x in zip(b.column("range").to_pylist(), b.column("entries").to_pylist()):
            e = np.frombuffer(x, np.int64).reshape(2 + SKETCH, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(e.shape[1], name, np.int32)), *map(pa.array, e)], ["range", "key", "cid", *SKETCHES])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_single`` undone: the entries of each range in a batch as one row."""
    for b in batches:
        names, e = b.column("range").to_numpy(), np.stack([b.column(c).to_numpy() for c in ("key", "cid", *SKETCHES)])
        each = np.unique(names)
        yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array([e[:, names == x].tobytes() for x in each], pa.binary())], ["range", "entries"])


def _compare(new: pa.Table, old: pa.Table | None = None) -> pa.Table:
    """Pairs of classes of one key range (of ``new`` and ``old``, or within ``new``) in a window together whose sketches agree
    often enough."""

    found = [np.empty((2, 0), np.int64)]
    if new.num_rows and (old is None or old.num_rows):
        key_a, cid_a, *sketch_a = _entries(new.column("entries").to_pylist())
        key_b, cid_b, *sketch_b = (key_a, cid_a, *sketch_a) if old is None else _entries(old.column("entries").to_pylist())
        for i, j in windows_within(key_a) if old is None else windows(key_a, key_b):
            near = S.agreement([x[i] for x in sketch_a], [x[j] for x in sketch_b]) >= MIN_AGREE
            x, y = cid_a[i[near]], cid_b[j[near]]
            x, y = x[x != y], y[x != y]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    return pa.table(list(np.concatenate(found, 1)), ["cid_a", "cid_b"])


def _compare_within(new: pa.Table) -> pa.Table:
    return _compare(new)


def _numbers(valid: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """A number from 0 on for each kind of row, -1 where not valid."""
    at = np.flatnonzero(valid)
    at = at[np.lexsort([c[at] for c in columns])]
    other = np.zeros(len(at), bool)
    for c in columns:
        other[1:] |= np.diff(c[at]) != 0
    out = np.full(len(valid), -1, np.int64)
    out[at] = np.cumsum(other)
    return out


def _last_rounds(turn: pa.Table, links: pa.Table) -> pa.Table:
    """The rounds of ``History._resolve`` that follow ``turn``, by arrays: gid, kept_gid of the rows that they refuse."""
    turn = turn.sort_by("gid")
    gid, done = turn.column("gid").to_numpy(), turn.column("done").to_numpy()
    i1, i2, cid = (turn.column(c).fill_null(0).to_numpy() for c in ("i1", "i2", "cid"))
    dup, kept = turn.column("dup_gid").fill_null(-1).to_numpy(), turn.column("kept_gid").fill_null(NONE).to_numpy()
    ident, held = _numbers(turn.column("i1").is_valid().to_numpy(), i1, i2), turn.column("cid").is_valid().to_numpy()
    classes, text = np.unique(cid[held]), np.full(len(gid), -1, np.int64)
    text[held] = np.searchsorted(classes, cid[held])
    # links between classes of the turn, as numbers of the classes
    ends = np.stack([links.column(c).to_numpy() for c in ("cid", "other")]) if links.num_rows and len(classes) else np.empty((2, 0), np.int64)
    place = np.searchsorted(classes, ends)
    a, b = place[:, (classes[np.minimum(place, len(classes) - 1)] == ends).all(0)] if ends.size else ends
    n_ident, n_text = ident.max(initial=-1) + 1, len(classes)

    def least(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n + 1, NONE)  # the last is that of number -1
        np.minimum.at(out, number, values)
        out[-1] = NONE
        return out

    refused = [np.empty((2, 0), np.int64)]
    while not done.all():
        open_, taken = ~done, done & (kept == NONE)
        first_ident, got_ident = (least(ident[x], gid[x], n_ident) for x in (open_, taken))
        first, got = (least(text[x], gid[x], n_text) for x in (open_, taken))
        own = first[a] != NONE
        a, b = a[own], b[own]
        first_near, got_near = (least(a, x[b], n_text) for x in (first, got))
        at = np.minimum(np.searchsorted(gid, dup), len(gid) - 1)
        named = gid[at] == dup
        got_dup = np.where(named & done[at], np.where(kept[at] == NONE, gid[at], kept[at]), NONE)
        dup_open = named & open_[at]
        by_ident, by_text = got_ident[ident], np.minimum(got[text], got_near[text])
        refuse = np.where(by_ident != NONE, by_ident, np.where(got_dup != NONE, got_dup, by_text))
        clear = ((ident < 0) | (first_ident[ident] == gid)) & ((text < 0) | (first[text] == gid)) & (first_near[text] > gid) & ~dup_open
        gid, ident, text, dup, kept, clear = (x[open_] for x in (gid, ident, text, dup, refuse, clear))
        done = clear | (kept != NONE)
        refused.append(np.stack([gid, kept])[:, kept != NONE])
    return pa.table(list(np.concatenate(refused, 1)), ["gid", "kept_gid"])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and marks (sort keys and sketch, one after the other) of each row; null for rows of few words."""
    for b in batches:
        rows, norms = S.normal_texts(b, ("content",))
        n = b.num_rows
        few = np.ones(n, bool)
        few[rows] = False
        cid, marks = np.zeros(n, np.int64), np.full(n, None, object)
        if norms:
            hashes, counts = S.shingle_hashes(pa.array(norms))
            mins = S.min_hashes(hashes, counts, 2 * PASSES + 16 * SKETCH, seed=3)
            own = np.stack([*(sort_key(mins[:, 2 * p], mins[:, 2 * p + 1], p) for p in range(PASSES)), *S.nibble_sketch(mins[:, 2 * PASSES :])], 1)
            cid[rows] = S.text_classes(norms)
            marks[rows] = [x.tobytes() for x in own]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row_id", "i1", "i2", "dup")] + [pa.array(cid, mask=few), pa.array(marks, pa.binary())], ["row_id", "i1", "i2", "dup", "cid", "marks"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, norms = S.normal_texts(b, ("content",))
        yield pa.RecordBatch.from_arrays([pa.array(S.text_classes(norms)), pa.array(norms, pa.string())], ["cid", "norm"])


class History:
    """What has been accepted so far: sorted runs of keys, and the settled rows, in the shared folder.

    ``rows`` holds all rows that may be delivered (it is read by row id, never scanned for comparison); the columns
    are named by the arguments. ``state.json``-like bookkeeping is kept in ``self.manifest`` and can be saved and
    loaded, so that the next batch may be handled by another session. Runs and settled rows stay in the shared folder
    (with ``lasting`` false only as long as the application); ``close`` drops the names of the runs.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, row_id: str = "evidence_id", key: str = "source_key", duplicate_of: str = "duplicate_of", content: str = "content", threshold: float = S.THRESHOLD, manifest: str | None = None, lasting: bool = True):
        self.spark, self.threshold, self.place = spark, threshold, kept if lasting else scratch
        self.small = False
        self.rows = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(key).cast("string").alias("key"), F.col(duplicate_of).cast("string").alias("dup"), F.col(content).cast("string").alias("content"), *[c for c in ("batch_no",) if c in rows.columns])
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.names: list[int] | None = None
        self.runs: list[tuple[str, str]] = []
        self.settled: list[str] = []
        self.delivered: list[DataFrame] = []
        if manifest:
            saved = json.loads(manifest)
            self.buckets, self.settled = saved["buckets"], saved["settled"]
            self.delivered = [self.rows]  # contents of earlier sessions are looked up by row id
            for path in saved["runs"]:
                self._register(path)

    @property
    def manifest(self) -> str:
        return json.dumps({"buckets": self.buckets, "settled": self.settled, "runs": [p for _, p in self.runs]})

    def _register(self, path: str) -> None:
        name = f"run_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({RUN}) using parquet options (path '{path}') clustered by (range) sorted by (range, low) into {self.buckets} buckets")
        self.runs.append((name, path))

    def _write_run(self, entries: DataFrame) -> None:
        name, path = f"run_{uuid.uuid4().hex}", self.place(self.spark, "p3-run")
        entries.repartition(self.buckets, "range").mapInArrow(_in_order, RUN).write.bucketBy(self.buckets, "range").sortBy("range", "low").option("path", path).saveAsTable(name)
        self.runs.append((name, path))

    def _names(self) -> list[int]:
        """The names of the key ranges, such that each range is one bucket."""
        if self.names is None:
            names, n = {}, 32 * self.buckets
            while len(names) < self.buckets:
                label = F.col("id").cast("int")
                for r in self.spark.range(0, n, 1, 1).select(label.alias("label"), F.pmod(F.hash(label), F.lit(self.buckets)).alias("bucket")).collect():
                    names.setdefault(r.bucket, r.label)
                n *= 2
            self.names = [names[k] for k in range(self.buckets)]
        return self.names

    def _settled(self) -> DataFrame:
        return self.spark.read.schema(SETTLED).parquet(*self.settled)

    def compact(self) -> None:
        """Merge all runs into one, without the classes of which no row was accepted."""
        accepted = self._settled().where("kept_gid is null and cid is not null").select("cid").distinct()
        merged = self.spark.table(self.runs[0][0])
        for name, _ in self.runs[1:]:
            merged = merged.union(self.spark.table(name))
        old, self.runs = self.runs, []
        single = merged.select("range", "entries").mapInArrow(_single, "range int, key bigint, cid bigint, " + ", ".join(f"{k} bigint" for k in SKETCHES))
        self._write_run(single.join(accepted, "cid", "left_semi").select("range", "key", "cid", *SKETCHES).mapInArrow(_gathered, "range int, entries binary"))
        for name, path in old:
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, path)

    def close(self) -> None:
        """Drop the names of the runs from the catalog; their files stay."""
        for name, _ in self.runs:
            self.spark.sql(f"drop table if exists {name}")

    def accept(self, delivery: DataFrame) -> DataFrame:
        """Settle a delivery (rows of ``self.rows``): kept_id, row_id of the rows that repeat an accepted one.

        In the order of row_id a row is not accepted if an accepted row has its identifier, or its duplicate_of leads
        to an accepted row, directly or over rows that weren't accepted, or an accepted row's content is alike (both of
        20 words or more). Of several accepted rows, one of earlier deliveries comes first, then by identifier, by
        duplicate_of, by content the smallest. Null row ids are left out; a row delivered twice counts once; null,
        blank or empty keys and contents match nothing; a duplicate_of that is unknown or not smaller leads nowhere.
        """
        self.delivered.append(delivery)
        self.area = f"p3-{uuid.uuid4().hex}"  # a folder for what only this delivery needs
        ident = identifier("key")
        wide = delivery.where("row_id is not null").select(
            "row_id", F.when(ident.isNotNull(), F.xxhash64(ident)).alias("i1"), F.when(ident.isNotNull(), F.xxhash64(F.lit("second"), ident)).alias("i2"), F.when(F.col("dup") < F.col("row_id"), F.col("dup")).alias("dup"), "content"
        )
        wide, seen = measured(wide.mapInArrow(_prepare, "row_id string, i1 bigint, i2 bigint, dup string, cid bigint, marks binary"), f"{self.area}/base")
        self.small = seen["rows"] <= BROADCAST_ROWS
        # numbers in the order of row_id, above those of earlier deliveries
        ordered = wide.select("row_id", "i1", "i2", "dup", "cid").repartitionByRange(self.buckets, "row_id").sortWithinPartitions("row_id")
        rows = materialize(ordered.withColumn("gid", F.monotonically_increasing_id() + F.lit(len(self.settled) << 50)), f"{self.area}/rows")
        self._write_run(wide.where("cid is not null").select("cid", "marks").mapInArrow(_lay_out(self._names()), "range int, entries binary"))
        refused = self._resolve(rows, *self._links(rows))
        path = self.place(self.spark, "p3-settled")
        rows.join(self._narrow(refused), "gid", "left").select("gid", "row_id", "i1", "i2", "cid", "kept_gid").write.parquet(path)
        self.settled.append(path)
        if len(self.runs) > MAX_RUNS:
            self.compact()
        found = self.spark.read.schema(SETTLED).parquet(path).where("kept_gid is not null").select("row_id", F.col("kept_gid").alias("gid"))
        # of the history only the rows that are named
        heads = self._settled().select("gid", F.col("row_id").alias("kept_id")).join(self._narrow(found.select("gid").distinct()), "gid", "left_semi")
        out = materialize(found.join(self._narrow(heads), "gid").select("kept_id", "row_id").where("kept_id <> row_id").distinct(), "p3-found")
        remove(self.spark, f"{shared_dir(self.spark)}/{self.area}")
        return out

    def _narrow(self, df: DataFrame) -> DataFrame:
        """``df``, a table of no more rows than the delivery and its candidate pairs: broadcast if these are few."""
        return F.broadcast(df) if self.small else df

    def _links(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Pairs of alike classes (both directions: cid, other), at least one of them new, and their number."""
        new = self.spark.table(self.runs[-1][0])
        pairs = None
        for name, _ in self.runs:
            if name == self.runs[-1][0]:
                met = new.groupBy("range").applyInArrow(_compare_within, "cid_a bigint, cid_b bigint")
            else:
                met = new.groupBy("range").cogroup(self.spark.table(name).groupBy("range")).applyInArrow(lambda a, b: _compare(a, b), "cid_a bigint, cid_b bigint")
            pairs = met if pairs is None else pairs.union(met)
        pairs, seen = measured(pairs.repartition("cid_a").dropDuplicates(["cid_a", "cid_b"]), f"{self.area}/candidates")
        few = 2 * seen["rows"] <= BROADCAST_ROWS
        self.small = self.small and few
        narrow = F.broadcast if few else lambda df: df
        known = rows.select("row_id", "cid")
        if self.settled:
            known = known.union(self._settled().select("row_id", "cid"))
        # the content of one row of each class that a window names
        named = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
        ids = known.where("cid is not null").join(narrow(named), "cid", "left_semi").groupBy("cid").agg(F.min("row_id").alias("row_id"))
        contents = reduce(DataFrame.union, [x.select("row_id", "content") for x in self.delivered])
        texts = contents.join(narrow(ids.select("row_id")), "row_id", "left_semi").select("content").mapInArrow(_texts, "cid bigint, norm string")
        texts = texts.groupBy("cid").agg(F.first("norm").alias("norm"))
        ta, tb = (texts.select(F.col("cid").alias(f"cid_{n}"), F.col("norm").alias(f"norm_{n}")) for n in "ab")
        alike = pairs.join(ta, "cid_a").join(tb, "cid_b").where(S.jaccard(F.col("norm_a"), F.col("norm_b")) >= self.threshold)
        both = F.array(F.struct(F.col("cid_a").alias("cid"), F.col("cid_b").alias("other")), F.struct(F.col("cid_b").alias("cid"), F.col("cid_a").alias("other")))
        links, seen = measured(alike.select(F.explode(both).alias("l")).select("l.*"), f"{self.area}/links")
        return links, seen["rows"]

    def _against_history(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """gid, i1, i2, cid, dup_gid (the row of this delivery that duplicate_of names), and kept_gid where an accepted row of
        an earlier delivery is repeated. Of the history only what the delivery asks for is shuffled."""
        duplicates = rows.where("dup is not null").select("gid", "dup")
        targets = rows.select("row_id", F.col("gid").alias("dup_gid"), F.lit(None).cast("bigint").alias("root"))
        if self.settled:
            targets = targets.union(self._settled().select("row_id", F.lit(None).cast("bigint"), F.coalesce("kept_gid", "gid")))
        by_dup = targets.withColumnRenamed("row_id", "dup").join(self._narrow(duplicates), "dup").groupBy("gid").agg(F.min("dup_gid").alias("dup_gid"), F.min("root").alias("root"))
        out = rows.select("gid", "i1", "i2", "cid").join(self._narrow(by_dup), "gid", "left")
        if not self.settled:
            return out.select("gid", "i1", "i2", "cid", "dup_gid", F.lit(None).cast("bigint").alias("kept_gid"))
        accepted = self._settled().where("kept_gid is null").select("gid", "i1", "i2", "cid")
        by_ident = accepted.join(self._narrow(rows.where("i1 is not null").select("i1").distinct()), "i1", "left_semi").groupBy("i1", "i2").agg(F.min("gid").alias("by_ident"))
        around = rows.where("cid is not null").select("cid").distinct()
        reach = links.join(self._narrow(around), "cid", "left_semi").union(around.select("cid", F.col("cid").alias("other")))
        by_text = accepted.select(F.col("cid").alias("other"), "gid").join(self._narrow(reach), "other").groupBy("cid").agg(F.min("gid").alias("by_text"))
        out = out.join(self._narrow(by_ident), ["i1", "i2"], "left").join(self._narrow(by_text), "cid", "left")
        return out.select("gid", "i1", "i2", "cid", "dup_gid", F.coalesce("by_ident", "root", "by_text").alias("kept_gid"))

    def _resolve(self, rows: DataFrame, links: DataFrame, linked: int) -> DataFrame:
        """gid, kept_gid of the refused rows, decided in rounds: a row is refused if something accepted repeats in it, and
        accepted if nothing undecided before it could. Identifiers and classes are judged by their first row, so copies cost
        nothing. What a round accepts is judged upon in the next one, so each round needs the last one's outcome only. Once that
        is small, one task decides the rest (``_last_rounds``)."""
        open_ = ~F.col("done")
        turn, seen = measured(self._against_history(rows, links).withColumn("done", F.col("kept_gid").isNotNull()), f"{self.area}/round", left=F.count_if(open_))
        turns, left = [turn], seen["left"]
        while left and (seen["rows"] > LAST_ROWS or linked > LAST_LINKS):
            first, got = F.min(F.when(open_, F.col("gid"))), F.min(F.when(F.col("done") & F.col("kept_gid").isNull(), F.col("gid")))
            idents = turn.where("i1 is not null").groupBy("i1", "i2").agg(first.alias("first_ident"), got.alias("got_ident"))
            heads = turn.where("cid is not null").groupBy("cid").agg(first.alias("first"), got.alias("got"))
            near = links.join(self._narrow(heads.withColumnRenamed("cid", "other")), "other").groupBy("cid").agg(F.min("first").alias("first_near"), F.min("got").alias("got_near"))
            named = turn.where(open_ & F.col("dup_gid").isNotNull()).select("dup_gid").distinct()
            fates = turn.select(F.col("gid").alias("dup_gid"), open_.alias("dup_open"), F.when(F.col("done"), F.coalesce("kept_gid", "gid")).alias("got_dup")).join(self._narrow(named), "dup_gid")
            state = turn.where(open_).drop("kept_gid", "done").join(self._narrow(idents), ["i1", "i2"], "left").join(self._narrow(heads), "cid", "left").join(self._narrow(near), "cid", "left").join(self._narrow(fates), "dup_gid", "left")
            refuse = F.coalesce("got_ident", "got_dup", F.least("got", "got_near"))
            own = F.col("gid")
            clear = F.coalesce(F.col("first_ident") == own, F.lit(True)) & F.coalesce(F.col("first") == own, F.lit(True)) & F.coalesce(F.col("first_near") > own, F.lit(True)) & ~F.coalesce("dup_open", F.lit(False))
            turn, seen = measured(state.select("gid", "i1", "i2", "cid", "dup_gid", refuse.alias("kept_gid"), (refuse.isNotNull() | clear).alias("done")), f"{self.area}/round", left=F.count_if(open_))
            turns.append(turn)
            left = seen["left"]
        refused = reduce(DataFrame.union, turns).where("kept_gid is not null").select("gid", "kept_gid")
        if left:
            one, other = (x.withColumn("one", F.lit(0)).groupBy("one") for x in (turn, links))
            refused = refused.union(one.cogroup(other).applyInArrow(_last_rounds, "gid bigint, kept_gid bigint"))
        return refused


def replay(spark: SparkSession, rows: DataFrame, bounds: tuple[int, ...], **names: str) -> DataFrame:
    """Hand all batches over in deliveries: batch_no below the first bound, below the second, and so on, then the rest
    (a null batch_no comes with the first). The result doesn't depend on how batches are grouped."""
    history = History(spark, rows, lasting=False, **names)
    batch = F.coalesce("batch_no", F.lit(0))
    found = None
    try:
        for lo, hi in zip((None, *bounds), (*bounds, None)):
            part = history.rows
            if lo is not None:
                part = part.where(batch >= lo)
            if hi is not None:
                part = part.where(batch < hi)
            out = history.accept(part)
            found = out if found is None else found.union(out)
    finally:
        history.close()
    return found
