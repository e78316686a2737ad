"""What is learnt or told about models with plain aggregations: a lookup baseline, gains of single splits, profiles of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_frequent(df: DataFrame, by: list[str], label: str, name: str) -> DataFrame:
    """(by, name): the most frequent label of each group, the smallest if some are equal; null labels don't count."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("label")))
    return counts.groupBy(*by).agg(best["label"].alias(name))


def lookup_predictions(held: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The test rows of held (fold, part, keys, label) with ``prediction``, the most frequent label of their keys in training.

    Keys that training lacks, and null keys, get the fold's most frequent label;
    a fold without labelled training rows gives nulls.  The table of keys is as
    large as the keys are many, so Spark chooses how it joins; the folds' own
    labels are one row a fold.
    """
    train, test = held.where("part = 'train'"), held.where("part = 'test'")
    by_keys = most_frequent(train, ["fold", *keys], label, "__own")
    by_fold = most_frequent(train, ["fold"], label, "__fold")
    joined = test.join(by_keys, ["fold", *keys], "left").join(F.broadcast(by_fold), "fold", "left")
    return joined.withColumn("prediction", F.coalesce("__own", "__fold")).select(*held.columns, "prediction")


def split_gains(rows: DataFrame, edges: list[float]) -> DataFrame:
    """(feature, edge, gain) of each feature's best single split of rows (feature, value, label).

    A split puts values below one of ``edges`` (ascending) to the left; its gain
    is how much the Gini impurity of the labels falls, and of equal gains the
    lowest edge counts.  Rows are counted by feature, bin and label in one
    shuffle, and all that follows works on these counts.  Nulls and NaN take no
    part; a feature whose values no edge parts has a null edge and a gain of 0;
    an empty table gives an empty one.
    """
    known = rows.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("label").isNotNull())
    n_bin: Column = F.lit(0)
    for e in edges:
        n_bin = n_bin + (F.col("value").cast("double") >= e).cast("int")
    counts = known.groupBy("feature", n_bin.alias("bin"), "label").agg(F.count("*").cast("double").alias("n"))
    # a bin lies to the left of the cuts after it; with a cut of its own for all bins each label has all cuts
    bins = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    labels = counts.groupBy("feature", "label").agg(bins.alias("bins"), F.sum("n").alias("all"))
    cut = F.explode(F.sequence(F.lit(1), F.lit(len(edges)))).alias("cut")
    below = F.aggregate(
        F.map_entries("bins"), F.lit(0.0), lambda a, e: a + F.when(e["key"] < F.col("cut"), e["value"]).otherwise(0.0)
    )
    sides = labels.select("feature", "label", "bins", "all", cut).withColumn("left", below)
    right = F.col("all") - F.col("left")

    def purity(c: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(c * c), F.sum(c)), F.lit(0.0))

    both = sides.groupBy("feature", "cut").agg(
        F.sum("left").alias("n_left"), F.sum(right).alias("n_right"),
        ((purity(F.col("left")) + purity(right) - purity(F.col("all"))) / F.sum("all")).alias("gain"),
    )
    parts = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    best = F.min(F.when(parts, F.struct((-F.col("gain")).alias("g"), F.col("cut").alias("cut"))))
    found = both.groupBy("feature").agg(best.alias("best"))
    edge = F.when(F.col("best").isNotNull(), F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("best.cut")))
    return found.select("feature", edge.alias("edge"), F.coalesce(-F.col("best.g"), F.lit(0.0)).alias("gain"))


def group_profiles(df: DataFrame, key: str, columns: list[str], dominant: str) -> DataFrame:
    """(key, n, mean and deviation of each column, dominant): dominant is the number of the column with the highest mean.

    Of equal means the first counts; a group of one row has null deviations, nulls are left out of both.
    """
    stats = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    rows = df.groupBy(key).agg(F.count("*").alias("n"), *stats)
    best = F.array_max(F.array(*[F.struct(F.col(f"{c}_mean").alias("m"), F.lit(-k).alias("k")) for k, c in enumerate(columns)]))
    return rows.withColumn(dominant, -best["k"])


def squared_distances(columns: list[str], centers: list[list[float]]) -> Column:
    """The squared distances of a row to each of a few centers, in their order."""
    return F.array(*[sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, center, strict=True)), F.lit(0.0)) for center in centers])
