from pyspark.sql import functions as F

from termloom.plans import identity


def test_places_are_dealt_once_each(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = spark.range(60_000, numPartitions=8).select(F.md5(F.col("id").cast("string")).alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("more"))
        got = [(r["key"], r["place"]) for r in identity.placed(rows, ["key"]).select("key", "place", "more").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(x for _, x in got) == list(range(1, 60_001))
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)
