from rivulet.session import cut, ship


def test_cut_keeps_rows(spark):
    df = spark.range(3)
    assert sorted(r.id for r in cut(df).collect()) == [0, 1, 2]


def test_code_is_shipped_once(spark):
    ship(spark)
    n = len(spark.sparkContext._python_includes)
    ship(spark)
    assert len(spark.sparkContext._python_includes) == n
