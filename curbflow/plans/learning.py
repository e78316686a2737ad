"""Queries of time-ordered splits, reports, models and profile clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.operators import models
from curbflow.operators.layout import with_row_index
from curbflow.operators.profile import exact_quantiles
from curbflow.sources.scratch import new_folder

from .registry import query, table
from .series import PANEL, STATE, panel


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """Expanding splits: train on rows before the first bound, test from it to the second."""
    size = n // (folds + 1)
    return [(n - (folds - i) * size, n - (folds - i - 1) * size) for i in range(folds)]


def with_folds(df: DataFrame, order: list[str], folds: int) -> DataFrame:
    """(fold, part, columns): each row once for each fold whose training or test rows hold it."""
    indexed = with_row_index(df, order)
    n = df.count()
    rows = [(i, a, b) for i, (a, b) in enumerate(fold_bounds(n, folds))]
    bounds = df.sparkSession.createDataFrame(rows, "fold int, test_start long, test_end long")
    held = indexed.join(F.broadcast(bounds), F.col("row") < F.col("test_end"))
    part = F.when(F.col("row") < F.col("test_start"), "train").otherwise("test")
    return held.withColumn("part", part).drop("test_start", "test_end")


FOLDS = """r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
 b AS (SELECT k AS fold, any_value(n) - (3 - k) * (any_value(n) // 4) AS s, any_value(n) - (2 - k) * (any_value(n) // 4) AS e FROM r, range(3) t(k) GROUP BY 1),
 f AS (SELECT fold, CASE WHEN i < s THEN 'train' ELSE 'test' END AS part, event_id, ts FROM r JOIN b ON i < e)"""


@query("ml1_time_folds", f"WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, part, event_id FROM f")
def ml1(spark, sf):
    return with_folds(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 3).select("fold", "part", "event_id")


@query("ml9_fold_metadata", f"WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY 1, 2")
def ml9(spark, sf):
    folds = with_folds(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 3)
    return folds.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) from counts of pairs."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    real = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    said = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    both = real.join(said, "label", "left")
    precision = F.coalesce(F.col("hits") / F.col("said"), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


@query(
    "ml4_classification_report",
    """WITH p AS (SELECT quality AS t, CAST(n_chars > 600 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT t AS label FROM p),
       m AS (SELECT label, count(*) FILTER (t = label AND p = label) AS h, count(*) FILTER (p.p = label) AS s, count(*) FILTER (t = label) AS support FROM p, l GROUP BY 1)
       SELECT label, round(coalesce(h / nullif(s, 0), 0), 6) AS precision, round(h / support, 6) AS recall, round(CASE WHEN h = 0 THEN 0 ELSE 2.0 * h / (s + support) END, 6) AS f1, support FROM m""",
)
def ml4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 600).cast("int").alias("p"))
    both = table(spark, sf, "labels").select("doc_id", "quality").join(d, "doc_id")
    report = classification_report(both, "quality", "p")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def embedded(spark, sf) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features"))


@query("ml2_multiclass_trees")
def ml2(spark, sf):
    """Confusion counts of a forest on the last quarter, trained on the rows before it."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = with_row_index(embedded(spark, sf), ["vec_id"])
    cut = table(spark, sf, "embeddings").count() * 3 // 4
    model = RandomForestClassifier(numTrees=10, maxDepth=5, seed=42).fit(rows.where(F.col("row") < cut))
    said = model.transform(rows.where(F.col("row") >= cut))
    return said.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@query("ml2_boosted_trees")
def ml2_boosted(spark, sf):
    """Which of a vector's first four components is the largest, learnt from eight: confusion counts on the last quarter.

    The eighth before it says when to stop.
    """
    from curbflow.operators.boosting import boosted_trees

    e = table(spark, sf, "embeddings").where("embedding is not null")
    names = [f"v{i}" for i in range(8)]
    first = F.slice("embedding", 1, 4)
    largest = F.array_position(first, F.array_max(first)).cast("int").alias("label")
    rows = with_row_index(e.select("vec_id", largest, *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), ["vec_id"])
    n = e.count()
    train = rows.where(F.col("row") < n * 6 // 8).withColumn("valid", F.col("row") >= n * 5 // 8)
    model = boosted_trees(train, names, "label", "valid", rounds=20, depth=3, n_bins=16)
    said = model.predict(rows.where(F.col("row") >= n * 6 // 8))
    return said.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("ml3_temporal_baseline")
def ml3(spark, sf):
    """Accuracy by fold of a tree on clock features alone."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    p = panel(spark, sf).select("event_id", "ts", "state", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), F.dayofmonth("ts").alias("day"))
    folds = with_folds(p, ["ts", "event_id"], 3)
    rows = VectorAssembler(inputCols=["hour", "dow", "day"], outputCol="features").transform(folds)
    out = None
    for fold in range(3):  # a fixed number of models
        mine = rows.where(F.col("fold") == fold)
        model = DecisionTreeClassifier(labelCol="state", maxDepth=5, seed=42).fit(mine.where("part = 'train'"))
        said = model.transform(mine.where("part = 'test'"))
        right = said.agg(F.lit(fold).alias("fold"), F.avg((F.col("prediction") == F.col("state")).cast("double")).alias("accuracy"))
        out = right if out is None else out.unionByName(right)
    return out


@query(
    "ml3_clock_lookup",
    f"""WITH {FOLDS}, x AS (SELECT fold, part, hour(f.ts) AS h, isodow(f.ts) AS d, CAST({STATE} AS INTEGER) AS s FROM f JOIN events USING (event_id)),
       o AS (SELECT fold, h, d, s, row_number() OVER (PARTITION BY fold, h, d ORDER BY count(*) DESC, s) AS i FROM x WHERE part = 'train' GROUP BY 1, 2, 3, 4),
       w AS (SELECT fold, s, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, s) AS i FROM x WHERE part = 'train' GROUP BY 1, 2),
       p AS (SELECT x.fold, x.s, coalesce(o.s, w.s) AS p FROM x LEFT JOIN o ON x.fold = o.fold AND x.h = o.h AND x.d = o.d AND o.i = 1 JOIN w ON x.fold = w.fold AND w.i = 1 WHERE part = 'test')
       SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(count(*) FILTER (s = p) / count(*), 9) AS accuracy FROM p GROUP BY 1""",
)
def ml3_lookup(spark, sf):
    """Accuracy by fold of the most frequent state of each hour and weekday of the training rows."""
    p = panel(spark, sf).select("event_id", "ts", "state", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"))
    said = models.lookup_predictions(with_folds(p, ["ts", "event_id"], 3), ["hour", "dow"], "state")
    right = F.avg((F.col("prediction") == F.col("state")).cast("double"))
    return said.groupBy("fold").agg(F.count("*").alias("n"), F.round(right, 9).alias("accuracy"))


EDGES = [i / 16 for i in range(-7, 8)]


@query(
    "ml5_split_gains",
    f"""WITH v AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS feature, unnest(embedding) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
       b AS (SELECT feature, label, len(list_filter({EDGES}, lambda e: e <= CAST(x AS DOUBLE))) AS bin, count(*) AS n FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1, 2, 3),
       t AS (SELECT feature, label, CAST(sum(n) AS DOUBLE) AS c FROM b GROUP BY 1, 2),
       l AS (SELECT feature, label, k, c, CAST(coalesce(sum(n) FILTER (bin < k), 0) AS DOUBLE) AS l FROM t JOIN b USING (feature, label), range(1, {len(EDGES) + 1}) r(k) GROUP BY 1, 2, 3, 4),
       g AS (SELECT feature, k, (sum(l * l) / nullif(sum(l), 0) + sum((c - l) * (c - l)) / nullif(sum(c - l), 0) - sum(c * c) / sum(c)) / sum(c) AS g FROM l GROUP BY 1, 2),
       o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY g DESC NULLS LAST, k) AS i FROM g)
       SELECT CAST(feature AS INTEGER) AS feature, CASE WHEN g IS NOT NULL THEN CAST({EDGES}[k] AS DOUBLE) END AS edge, round(coalesce(g, 0), 9) AS gain FROM o WHERE i = 1""",
)
def ml5_gains(spark, sf):
    """The best split of each component of the vectors by itself."""
    e = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    gains = models.split_gains(e.select("label", F.posexplode("embedding").alias("feature", "value")), EDGES)
    return gains.withColumn("gain", F.round("gain", 9))


@query("ml5_feature_importance")
def ml5(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(numTrees=10, maxDepth=5, seed=42).fit(embedded(spark, sf))
    weights = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return spark.createDataFrame(weights, "feature int, importance double").orderBy(F.desc("importance"), "feature").limit(20)


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their median, by their interquartile range where that isn't 0.

    The quantiles of all columns come from one layout of (column, value), so df
    is read twice whatever the number of columns; their table is one row with an
    entry for each column.  A column without values stays null.
    """
    values = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    quantiles = exact_quantiles(values, "value", [0.25, 0.5, 0.75], ["feature"])
    bounds = quantiles.agg(F.map_from_entries(F.collect_list(F.struct("feature", "quantiles"))).alias("__bounds"))
    scaled = {}
    for c in columns:
        q = F.try_element_at("__bounds", F.lit(c))
        scaled[c] = (F.col(c) - q[1]) / F.coalesce(F.nullif(q[2] - q[0], F.lit(0.0)), F.lit(1.0))
    return df.join(F.broadcast(bounds)).withColumns(scaled).drop("__bounds")


SHARES = [f"share_{k}" for k in range(5)]


def user_shares(spark, sf) -> DataFrame:
    shares = [(F.count_if(F.col("state") == k) / F.count("*")).alias(f"share_{k}") for k in range(5)]
    return panel(spark, sf).groupBy("user_id").agg(*shares)


@query(
    "ml7_scaled_profiles",
    f"""WITH {PANEL}, s AS (SELECT user_id, {", ".join(f"count(*) FILTER (state = {k}) / count(*) AS share_{k}" for k in range(5))} FROM panel GROUP BY 1),
        q AS (SELECT {", ".join(f"quantile_cont(share_{k}, 0.25) AS a{k}, quantile_cont(share_{k}, 0.5) AS b{k}, quantile_cont(share_{k}, 0.75) AS c{k}" for k in range(5))} FROM s)
        SELECT user_id, {", ".join(f"round((share_{k} - b{k}) / coalesce(nullif(c{k} - a{k}, 0), 1), 5) AS share_{k}" for k in range(5))} FROM s, q""",
)
def ml7_scaled(spark, sf):
    return robust_scaled(user_shares(spark, sf), SHARES).select("user_id", *[F.round(c, 5).alias(c) for c in SHARES])


def fitted_profiles(spark, sf, k: int):
    """The shares, their scaled form with a cluster each, and the centers."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    shares = user_shares(spark, sf)
    scaled = VectorAssembler(inputCols=SHARES, outputCol="features").transform(robust_scaled(shares, SHARES).orderBy("user_id"))
    model = KMeans(k=k, seed=42).fit(scaled)
    found = model.transform(scaled).withColumnRenamed("prediction", "cluster")
    return shares, found, [c.tolist() for c in model.clusterCenters()]


def profile_clusters(spark, sf, k: int = 3) -> DataFrame:
    shares, found, _ = fitted_profiles(spark, sf, k)
    return shares.join(found.select("user_id", "cluster"), "user_id")


@query("ml7_profile_clusters")
def ml7(spark, sf):
    return profile_clusters(spark, sf).select("user_id", "cluster")


@query("ml8_cluster_characteristics")
def ml8(spark, sf):
    """Size, mean and deviation of each share, and the dominant state, by cluster."""
    return models.group_profiles(profile_clusters(spark, sf), "cluster", SHARES, "dominant_state")


@query("ml7_nearest_centers", "SELECT count(DISTINCT user_id) AS n, 0 AS n_nearer FROM events")
def ml7_nearest(spark, sf):
    """Users whose cluster has a center, and those to whom another center is nearer, by distances worked out again."""
    _, found, centers = fitted_profiles(spark, sf, 3)
    away = models.squared_distances(SHARES, centers)
    nearer = F.element_at(away, F.col("cluster") + 1) > F.array_min(away) + 1e-9
    return found.agg(F.count("cluster").alias("n"), F.count_if(nearer).cast("int").alias("n_nearer"))


@query(
    "ml8_dominant_state_profiles",
    f"""WITH {PANEL}, s AS (SELECT user_id, {", ".join(f"count(*) FILTER (state = {k}) / count(*) AS share_{k}" for k in range(5))} FROM panel GROUP BY 1),
       c AS (SELECT *, list_position([{", ".join(SHARES)}], greatest({", ".join(SHARES)})) - 1 AS cluster FROM s),
       m AS (SELECT cluster, count(*) AS n, {", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in SHARES)} FROM c GROUP BY 1)
       SELECT CAST(cluster AS INTEGER) AS cluster, n, {", ".join(f"round({c}_{x}, 9) AS {c}_{x}" for c in SHARES for x in ("mean", "std"))},
              CAST(list_position([{", ".join(f"{c}_mean" for c in SHARES)}], greatest({", ".join(f"{c}_mean" for c in SHARES)})) - 1 AS INTEGER) AS dominant_state FROM m""",
)
def ml8_dominant(spark, sf):
    """The profiles of the users grouped by the state that each is in most often, the first of equal ones."""
    shares = user_shares(spark, sf)
    top = F.array_position(F.array(*SHARES), F.greatest(*SHARES)).cast("int") - 1
    profiles = models.group_profiles(shares.withColumn("cluster", top), "cluster", SHARES, "dominant_state")
    return profiles.withColumns({f"{c}_{x}": F.round(f"{c}_{x}", 9) for c in SHARES for x in ("mean", "std")})


def saved_and_loaded(spark, rows: DataFrame):
    """A fitted pipeline, and what comes back after it was saved to the shared folder."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import DecisionTreeClassifier

    path = new_folder(spark, "model")
    fitted = Pipeline(stages=[DecisionTreeClassifier(maxDepth=3, seed=42)]).fit(rows)
    fitted.write().overwrite().save(path)
    return fitted, PipelineModel.load(path)


@query("ml6_saved_model")
def ml6(spark, sf):
    """A fitted pipeline is saved to the shared folder, loaded again and applied."""
    rows = embedded(spark, sf)
    _, loaded = saved_and_loaded(spark, rows)
    return loaded.transform(rows).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("ml6_round_trip", "SELECT count(*) AS n, 0 AS n_changed FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL")
def ml6_round_trip(spark, sf):
    """Rows whose prediction or class probabilities a saved and loaded model changes."""
    rows = embedded(spark, sf)
    fitted, loaded = saved_and_loaded(spark, rows)
    before = fitted.transform(rows).select("vec_id", "features", F.struct("prediction", "probability").alias("before"))
    after = loaded.transform(before).select("before", F.struct("prediction", "probability").alias("after"))
    changed = F.col("before").cast("string") != F.col("after").cast("string")
    return after.agg(F.count("*").alias("n"), F.count_if(changed).cast("int").alias("n_changed"))
