"""Tasks stay small as tables grow."""

from tracequill.plans import roles


def test_tasks_grow_with_the_rows(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        df = roles.table(spark, "/root/testdata/sf0.01", "lineitem")
        roles.sized(df)
        assert {n: spark.conf.get(n) for n in names} == before
        roles.sized(df, read=1_000, shuffled=1_000)
        assert spark.conf.get(names[0]) == str(-(-df.count() // 1_000)) and spark.conf.get(names[1]) == f"{1 << 20}b"
        roles.sized(df, read=10_000, shuffled=10_000)
        assert spark.conf.get(names[0]) == str(-(-df.count() // 1_000))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
