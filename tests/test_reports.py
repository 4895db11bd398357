from plumbline.operators import history, reports

H = "series string, run_id string, at string, value double"


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, other = (sorted(r.k for r in reports.sample(df.repartition(n), "k", 20, 7).collect()) for n in (2, 7))
    assert one == other and len(one) == 20


def test_series_of_one_run_and_empty_history(spark):
    one = spark.createDataFrame([("a", "1", "2024-01-01", 5.0)], H)
    assert [tuple(r) for r in history.linear_forecast(one).select("n", "slope").collect()] == [(1, None)]
    assert [r.value for r in history.without_outliers(one).collect()] == [5.0]
    empty = one.limit(0)
    for f in (history.collected, history.autoregression, history.linear_forecast, history.without_outliers):
        assert f(empty).count() == 0


def test_parents_of_children_without_scores(spark):
    scores = spark.createDataFrame([("x", 90.0), ("x", 91.0), ("y", None)], "p string, score double")
    assert [tuple(r) for r in reports.parent_scores(scores, "p").collect()] == [("x", 2, 90.5)]
