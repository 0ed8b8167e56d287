from farpoint.operators.neighbors import TASK_PANES, TASK_POINTS, _spread


def test_tasks_shrink_with_the_slides_of_a_window(spark):
    df = spark.range(10).selectExpr("id AS k")
    rows = 4 * TASK_POINTS
    few, many = (_spread(df, df, ["k"], rows, panes)[0].rdd.getNumPartitions() for panes in (TASK_PANES, 50 * TASK_PANES))
    assert few == max(4, spark.sparkContext.defaultParallelism) and many == 200
