import duckdb
import pytest
from pyspark.sql import functions as F

from kithgraph.operators import history
from kithgraph.snapshots import Conflict, Snapshots
from kithgraph.sources import schemas


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_versions(spark, tmp_path, scheme):
    store = Snapshots(spark, f"{scheme}{tmp_path}/store")
    assert store.latest() is None and store.vacuum() == 0
    with pytest.raises(LookupError):
        store.read()
    assert store.write(spark.range(3)) == 0
    assert store.write(spark.range(5), after=0) == 1
    assert ids(store.read()) == list(range(5)) and ids(store.read(0)) == [0, 1, 2]
    with pytest.raises(Conflict):
        store.write(spark.range(9), after=0)
    assert store.latest() == 1 and ids(store.read()) == list(range(5))
    assert store.vacuum(keep=1) == 2 and store.commits() == [1] and ids(store.read()) == list(range(5))


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    store.write(spark.range(4))
    old = store.read()
    breaks = spark.range(1000).repartition(8).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.write(breaks, after=0)
    assert store.latest() == 0 and ids(store.read()) == ids(old) == [0, 1, 2, 3]
    assert store.write(spark.range(2), after=0) == 1 and ids(old) == [0, 1, 2, 3]


def test_an_update_that_loses_a_race_starts_again(spark, tmp_path):
    store, rival = Snapshots(spark, str(tmp_path / "store")), Snapshots(spark, str(tmp_path / "store"))
    store.write(spark.range(2))
    seen = []

    def change(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            rival.write(spark.range(7), after=0)
        return rows.union(spark.range(1))

    assert store.update(change) == 2 and seen == [2, 7] and store.read().count() == 8
    assert store.update(lambda rows: None) is None and store.latest() == 2
    with pytest.raises(Conflict):
        store.update(lambda rows: rival.write(spark.range(1), rival.latest()) and rows, attempts=2)


def entries(spark, rows):
    return spark.createDataFrame(rows, schemas.CACHE_ENTRY)


def keys(df):
    return sorted((r.key, r.data) for r in df.collect())


def test_cache_is_evicted_once_when_full(spark, tmp_path):
    store, now = Snapshots(spark, str(tmp_path / "cache")), 10**12
    old = now - history.EVICTION_AGE - 1
    assert history.put(store, entries(spark, [("cache-a", "aaaa", old, "1.0"), ("cache-b", "bbbb", now, "1.0"), ("xp-c", "cccc", old, "1.0")]), now, quota=100) == 0
    assert history.put(store, entries(spark, [("cache-b", "BB", now + 1, "1.0")]), now, quota=100) == 1
    assert keys(store.read()) == [("cache-a", "aaaa"), ("cache-b", "BB"), ("xp-c", "cccc")]
    # 11 + 9 + 8 characters are stored: 9 more are too many, but fit when the old entry goes
    assert history.put(store, entries(spark, [("cache-d", "dd", now, "1.0")]), now, quota=30) == 2
    assert keys(store.read()) == [("cache-b", "BB"), ("cache-d", "dd"), ("xp-c", "cccc")]
    # too many even then: nothing changes
    assert history.put(store, entries(spark, [("cache-e", "e" * 40, now, "1.0")]), now, quota=30) is None
    assert store.latest() == 2 and len(keys(store.read())) == 3
    assert history.cached(store.read(), "cache-b", F.lit(now)).first().data == "BB"


def test_repeated_and_null_entries(spark, tmp_path):
    store, now = Snapshots(spark, str(tmp_path / "cache")), 10**12
    history.put(store, entries(spark, [("cache-a", "1", 5, "1.0"), ("cache-a", "2", 7, "1.0"), (None, "x", 1, "1.0"), ("cache-n", None, None, None)]), now)
    assert keys(store.read()) == [("cache-a", "2"), ("cache-n", None)]
    history.put(store, entries(spark, []), now)
    assert len(keys(store.read())) == 2


def test_of_entries_of_one_time_null_data_counts_as_in_the_sql(spark):
    rows = [("cache-a", "x", 5, "1.0"), ("cache-a", None, 5, "1.0"), ("cache-b", "x", 6, "1.0"), ("cache-b", None, 5, "1.0"), ("cache-c", "x", 5, "1.0"), ("cache-c", "y", 5, "1.0")]
    got = {r.key: r.data for r in history.merged(None, entries(spark, rows)).collect()}
    want = "SELECT k, arg_max(struct_pack(d := d), (t, d)).d FROM (VALUES ('cache-a', 'x', 5), ('cache-a', NULL, 5), ('cache-b', 'x', 6), ('cache-b', NULL, 5), ('cache-c', 'x', 5), ('cache-c', 'y', 5)) v(k, d, t) GROUP BY k"
    assert got == dict(duckdb.sql(want).fetchall()) == {"cache-a": None, "cache-b": "x", "cache-c": "y"}
