import numpy as np
import pytest

from postloom.operators import quotient as Q


def surplus(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, id string, surplus string")
    return sorted(r.row_id for r in Q.exactly_once(df, "k", "id", **kw).where("surplus").collect())


def test_permutation_is_invertible():
    words = np.random.default_rng(1).integers(0, 1 << 63, (500, 4), dtype=np.uint64)
    assert (Q.unpermute(Q.permute(words)) == words).all()
    assert len({tuple(w) for w in Q.permute(words)}) == 500


def test_table_inserts_each_key_once_and_grows():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 900, (5000, 1), dtype=np.uint64) * np.ones((1, 5), np.uint64)
    table, seen = Q.QuotientTable(), set()
    for part in np.array_split(keys, 7):
        got = table.insert(part)
        for k, new in zip(part[:, 0], got):
            assert new == (k not in seen)
            seen.add(k)
    assert table.n == len(seen)


def test_fixed_width_keeps_tails_apart():
    a, b = b"x" * 40, b"x" * 41
    words, tails = Q.fixed_width([a, b, b"x\0", b"x"])
    assert tails[0] != tails[1]
    assert (words[2] != words[3]).any()


@pytest.mark.parametrize("shards", [1, 3])
def test_surplus_rows(spark, shards):
    rows = [("A:1", "r3", None), (" a:1\t", "r1", None), ("a:1", "r2", "x"), (None, "r4", None), ("  ", "r5", None), (None, "r6", None), ("b", "r7", None), ("b" * 70, "r8", None), ("b" * 70, "r9", None), ("b" * 69, "r10", None)]
    assert surplus(spark, rows, shards=shards) == ["r2", "r3", "r9"]


def test_repeated_rows_empty_and_null_ids(spark):
    assert surplus(spark, [("k", "r1", None), ("k", "r1", None)]) == ["r1"]
    assert surplus(spark, []) == []
    df = spark.createDataFrame([("k", None), ("k", "r1")], "k string, id string")
    assert [r.row_id for r in Q.exactly_once(df, "k", "id").where("surplus").collect()] == [None]


def test_hot_identifier(spark):
    df = spark.range(30_000, numPartitions=3).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "lpad(cast(id as string), 8, '0') as id")
    out = Q.exactly_once(df, "k", "id").groupBy("surplus").count().collect()
    assert {r.surplus: r["count"] for r in out} == {False: 20_001, True: 9_999}


def test_keys_come_back_from_places_and_remainders():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, (3000, 5), dtype=np.uint64)
    keys[:900, 0] = keys[0, 0]  # one quotient, many remainders: all lie far from their home
    table = Q.QuotientTable(bits=4)
    for part in np.array_split(keys, 9):
        assert table.insert(part).all()
    assert {tuple(k) for k in table.keys()} == {tuple(k) for k in keys}
    assert not table.insert(keys).any()


def test_shards_are_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).selectExpr("uuid() as k", "cast(id as string) as id")
    sizes = [r["count"] for r in Q.exactly_once(df, "k", "id", shards=8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)
