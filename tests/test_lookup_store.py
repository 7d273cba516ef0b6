"""Stores against the tables they were written from, and how little a look-up reads."""

import random

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import expand, profile
from kithgraph.sources import lookup_store

HOT, ROWS = 7, 6000


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [(HOT if r.random() < 0.35 else r.randrange(1000), HOT if r.random() < 0.2 else r.randrange(1000), "1", i) for i in range(ROWS)]
    rows += [(None, 3, "1", ROWS), (3, None, "1", ROWS + 1)]
    path = str(tmp_path_factory.mktemp("plain"))
    spark.createDataFrame(rows, "author long, subject long, balance string, ord long").repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def store(spark, edges, tmp_path_factory):
    return lookup_store.write(edges, str(tmp_path_factory.mktemp("store")), rows_per_file=150)


def scanned(df):
    """Rows that the scan hands on, after row groups are skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("key", ["author", "subject"])
def test_finds_what_a_filter_finds(edges, store, key):
    for wanted in ([HOT], [3], [11, 500, 999], [10_000], [-1], []):
        assert sorted(store.find(key, wanted).collect(), key=str) == sorted(edges.where(F.col(key).isin(wanted)).collect(), key=str)


def test_one_profile_is_in_a_file_or_two(edges, store):
    files = store.spark.read.parquet(f"{store.folder}/index_author").count()
    assert files >= 35
    for k in (3, 40, 500, 998):
        found = store.find("author", [k])
        assert 1 <= len(found.inputFiles()) <= 2 and scanned(found) <= 2 * 300
        assert scanned(found) < scanned(edges.where(F.col("author") == k))
    assert len(edges.inputFiles()) == 5  # the table itself: all files are opened


def test_the_first_rows_of_a_hot_key_need_few_files(edges, store):
    assert len(store.files("author", [HOT])) >= 10
    some = store.find("author", [HOT], first=50)
    assert len(some.inputFiles()) <= 2 and scanned(some) <= 2 * 300
    assert some.orderBy("ord").limit(50).collect() == edges.where(F.col("author") == HOT).orderBy("ord").limit(50).collect()


@pytest.mark.parametrize("root", [HOT, 3, 500, 12_345])
def test_networks_are_those_of_the_table(edges, store, root):
    for spec in (expand.VOUCHES, expand.ExpandSpec(10, 5, 5, 2, 5, 5, 60, True, expand.VOUCHES.keep, True)):
        assert sorted(expand.ego_network(store, root, spec).collect(), key=lambda r: r.seq) == sorted(expand.ego_network(edges, root, spec).collect(), key=lambda r: r.seq)


def test_a_new_version_leaves_open_stores_as_they_are(spark, tmp_path):
    one = spark.createDataFrame([(1, 2, 0)], "author long, subject long, ord long")
    first = lookup_store.write(one, str(tmp_path / "s"))
    second = lookup_store.write(one.withColumn("subject", F.lit(9).cast("long")), str(tmp_path / "s"))
    assert first.find("author", [1]).first().subject == 2 and second.find("author", [1]).first().subject == 9
    empty = lookup_store.write(one.limit(0), str(tmp_path / "e"))
    assert empty.find("author", [1]).count() == 0


def test_profiles_by_handle_and_address(spark, tmp_path):
    people = spark.createDataFrame([(i, f"name{i}", [f"address:0x{i:040X}", "service:x"]) for i in range(500)] + [(900, None, None), (901, "0x1", [])], "profile_id long, username string, userkeys array<string>")
    store = lookup_store.write(profile.key_table(people), str(tmp_path / "p"), keys=("key",), order="profile_id", rows_per_file=50)
    find = lambda text: [r.profile_id for r in profile.lookup_in(store, text).collect()]
    assert find(" name42 ") == [42] and find("0x" + f"{77:040x}") == [77] and find("NAME42") == find("") == find("0x" + "f" * 40) == [] and find("0x1") == [901]
    assert len(store.files("key", ["handle:name42"])) <= 2
    for text in (" name7", "0x" + f"{9:040X}", "nobody"):
        assert find(text) == [r.profile_id for r in profile.lookup(people, text).collect()]
