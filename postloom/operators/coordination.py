"""Coordinated posting within a group (a topic and week): near-duplicates by the ratio of matching text, and bursts.

Posts with the same normal text are one. All pairs of texts of a group are looked at, ``BLOCK`` texts against ``BLOCK`` in a task.
Matching characters are a common subsequence, and one of some letters only is within it, so the unmatched letters of the longest
one are no more than the unmatched characters: this bound refuses unlike texts. It is taken over the rarer letters, of one text
against many in one row of bits. The ratio decides the rest, in the order of the ids, where a link isn't already known.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.functions.text import normalise
from postloom.operators.bursts import bursts
from postloom.operators.components import connected_components
from postloom.operators.durable import materialize

#: The ratio from which posts are near-duplicates, the span of a burst and its least posts.
RATIO, SPAN_S, LEAST = 0.85, 7200, 4
#: Texts of one part of a group, texts in one row of bits, and the share of characters that the bound looks at.
BLOCK, STRIP, RARER = 1024, 128, 0.45


def _matcher(a: str, b: str) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(a=a, b=b, autojunk=False)


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters by the characters of both; of two empty texts 1, of one 0."""
    return pd.Series([_matcher(x, y).ratio() if x and y else float(x == y) for x, y in zip(a, b)], dtype="float64")


def _may_reach(unmatched: int | np.ndarray, total: int | np.ndarray) -> bool | np.ndarray:
    """Whether texts of ``total`` characters, so many of them without a match or more, can have the ratio."""
    return 2.0 * ((total - unmatched) // 2) / total >= RATIO


class _Strip:
    """Texts side by side in one row of bits, a gap behind each."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        self.places = {chr(c): bits(codes == c) for c in np.unique(codes) if c}
        self.all, self.size = bits(codes != 0), len(codes)
        self.lengths = np.array([len(x) for x in texts])
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1

    def unmatched(self, text: str) -> np.ndarray:
        """Of each text and ``text``, the letters outside their longest common subsequence."""
        v = self.all
        for c in text:
            u = v & self.places.get(c, 0)
            v = (v + u | v ^ u) & self.all  # a carry ends in the gap
        rest = np.unpackbits(np.frombuffer(v.to_bytes(-(-self.size // 8), "little"), np.uint8), count=self.size, bitorder="little")
        return len(text) - self.lengths + 2 * np.add.reduceat(rest, self.starts, dtype=np.int64)


def links(own: list[tuple[str, str]], others: list[tuple[str, str]] | None = None) -> Iterator[tuple[str, str]]:
    """Pairs of ids that tie together all (id, text) of ``own``, or of ``own`` and ``others``, whose ratio is ``RATIO`` or more.
    No text is empty. A pair that others tie together already is left out."""
    within = others is None
    own = sorted(own, key=lambda x: len(x[1]))
    others = own if within else sorted(others, key=lambda x: len(x[1]))
    counts = Counter()
    for _, text in own if within else own + others:
        counts.update(text)
    common, left, total = [], counts.total(), counts.total()
    for c, n in counts.most_common():
        if left - n < RARER * total:
            break
        common.append(c)
        left -= n
    drop = str.maketrans("", "", "".join(common))
    rare = [text.translate(drop) for _, text in own]
    sizes = np.array([len(text) for _, text in own])
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for at in range(0, len(others), STRIP):
        some = others[at : at + STRIP]
        strip, lengths = None, np.array([len(text) for _, text in some])
        for i, (x, text) in enumerate(own[: at + len(some)] if within else own):
            able = _may_reach(np.abs(lengths - sizes[i]), lengths + sizes[i])
            if within:
                able[: max(i + 1 - at, 0)] = False
            if not able.any():
                continue
            strip = strip or _Strip([t.translate(drop) for _, t in some])
            for j in np.flatnonzero(able & _may_reach(strip.unmatched(rare[i]), lengths + sizes[i])):
                y, other = some[j]
                if (p := root(x)) != (q := root(y)) and _may_reach(int(_Strip([other]).unmatched(text)[0]), len(text) + len(other)) and _matcher(*(z for _, z in sorted([(x, text), (y, other)]))).ratio() >= RATIO:
                    parent[p] = q
                    yield x, y


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit: rows of one group, one part of it (x = y) or two, in sequence."""
    unit, parts = None, {}

    def found() -> list[tuple[str, str, str]]:
        if unit is None:
            return []
        grp, x, y = unit
        ends = links(parts.get(x, [])) if x == y else links(parts.get(x, []), parts.get(y, []))
        return [(grp, a, b) for a, b in ends]

    def batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 3, ["grp", "head_a", "head_b"])

    for b in batches:
        rows = []
        for *key, part, head, text in zip(*(b.column(c).to_pylist() for c in ("grp", "x", "y", "part", "head", "text"))):
            if key != unit:
                rows += found()
                unit, parts = key, {}
            parts.setdefault(part, []).append((head, text))
        yield batch(rows)
    yield batch(found())


def clusters(posts: DataFrame, group: str, row_id: str, title: str, content: str) -> DataFrame:
    """grp, row_id, cluster (its smallest row id) of every post with a group and an id; equal rows count once. Texts without a
    word are alike. The work grows with the square of a group's different texts."""
    rows = posts.select(F.col(group).cast("string").alias("grp"), F.col(row_id).cast("string").alias("row_id"), normalise(F.col(title), F.col(content)).alias("text")).where("grp is not null and row_id is not null").distinct()
    heads = rows.groupBy("grp", "text").agg(F.min("row_id").alias("head"))
    rows = materialize(rows.select("grp", "row_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("print")), "posts")
    texts = materialize(heads.withColumn("print", F.sha2("text", 256)), "heads")
    full = texts.where("text <> ''")
    several = full.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = full.join(several, "grp").withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = placed.select("grp", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "head", "text")
    alike = units.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(_links, "grp string, head_a string, head_b string")
    node = lambda x: F.concat("grp", F.lit("\0"), x)
    parts = connected_components(alike.select(node("head_a").alias("a"), node("head_b").alias("b")))
    named = texts.select("grp", "print", "head", node("head").alias("node")).join(parts, "node", "left").select("grp", "print", F.coalesce(F.substring_index("component", "\0", -1), F.col("head")).alias("cluster"))
    return rows.join(named, ["grp", "print"]).select("grp", "row_id", "cluster")


def assess(posts: DataFrame, group: str, row_id: str, title: str, content: str, at: str) -> DataFrame:
    """Per group: raw_count, distinct_count (clusters), collapsed, duplicate_clusters (of two posts or more), bursts and reasons."""
    found = clusters(posts, group, row_id, title, content)
    sizes = found.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.groupBy("grp").agg(F.sum("n").alias("raw_count"), F.count(F.lit(1)).alias("distinct_count"), F.count_if(F.col("n") > 1).alias("duplicate_clusters"))
    burst = bursts(posts, group, at, row_id, SPAN_S, LEAST).groupBy("grp").agg(F.count(F.lit(1)).alias("bursts"), F.array_sort(F.collect_list(F.struct("from_s", "first_row", "posts"))).alias("each"))
    out = out.join(burst, "grp", "left").withColumn("collapsed", F.col("raw_count") - F.col("distinct_count"))
    # fixed values: the wording of the reasons
    told = F.when(F.col("collapsed") > 0, F.array(F.format_string("%d near-duplicate post(s) counted once (%d cluster(s))", "collapsed", "duplicate_clusters"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(told, F.coalesce(F.transform("each", lambda x: F.format_string(f"burst: %d posts within {SPAN_S // 3600}h", x["posts"])), F.array().cast("array<string>")))
    return out.select("grp", "raw_count", "distinct_count", "collapsed", "duplicate_clusters", F.coalesce("bursts", F.lit(0)).alias("bursts"), reasons.alias("reasons"))
