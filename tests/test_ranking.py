import random

from pyspark.sql import functions as F

from kithgraph.operators import ranking


def test_places_are_those_of_a_sort(spark):
    r = random.Random(1)
    rows = [(r.choice((5, 5, 5, None, r.randrange(100))), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = ranking.placed(df, F.desc_nulls_last("a"), "b", out="rank").collect()
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.rank)] == want and sorted(x.rank for x in got) == list(range(1, 3001))
    assert ranking.placed(df.limit(0), "a").count() == 0


def test_no_task_sees_all_rows(spark):
    df = spark.range(1000).withColumn("_at", F.col("id") % 3)
    out = ranking.placed(df, "id", first=0)
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert out.where("place <> id").count() == 0 and out.columns == ["id", "_at", "place"]
