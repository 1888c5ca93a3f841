import random

from termloom import queries


def test_long_chain_and_hub_against_union_find(spark, tmp_path):
    keys, customers = list(range(1, 1501)), list(range(1, 801))
    random.Random(1).shuffle(keys)
    spark.createDataFrame([(k,) for k in keys if k != 700], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k,) for k in customers], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in [(k, k - 1) for k in sorted(keys) if k not in (1, 700)] + [(-k, 0) for k in customers]:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r["obj"]: r["grp"] for r in queries.QUERIES["component_merge_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: top(x) for x in list(up)} and len(set(got.values())) == 3
