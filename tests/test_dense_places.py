"""Searches and counts whose work doesn't grow with the square of how dense places lie."""

from pyspark.sql import functions as F

from curbflow.operators import spatial


def task_peak(spark, since: int) -> int:
    """The most execution memory of one task of the stages from the given id on."""
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm
    no_quantiles = context._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, no_quantiles, jvm.java.util.ArrayList()).iterator()
    peak = 0
    while stages.hasNext():
        stage = stages.next()
        if stage.stageId() < since:
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 1000).iterator()
        while tasks.hasNext():
            metrics = tasks.next().taskMetrics()
            if metrics.isDefined():
                peak = max(peak, metrics.get().peakExecutionMemory())
    return peak


def newest_stage(spark) -> int:
    context = spark.sparkContext
    store, jvm = context._jsc.sc().statusStore(), context._jvm
    stages = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
    last = -1
    while stages.hasNext():
        last = max(last, stages.next().stageId())
    return last


def test_nearest_of_places_that_share_a_cell(spark):
    """5000 places in one cell of the given width: no task sorts all their pairs, ties still go to the smaller place."""
    n = 5000
    line = spark.range(n).select(F.col("id").alias("k"), (F.col("id") / 8192).alias("x"), F.lit(0.25).alias("y"))
    since = newest_stage(spark) + 1
    near = spatial.nearest(line, line.withColumnRenamed("k", "p"), "k", "p", 1.0, other=True)
    found = {r["k"]: (r["p"], r["distance"]) for r in near.collect()}
    assert found == {k: (k - 1 if k else 1, 1 / 8192) for k in range(n)}
    assert task_peak(spark, since) < 200e6
