"""From landed prediction answers to a report: slots, features, time folds, boosted trees, quality by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions import temporal
from curbflow.operators import spatial as sp
from curbflow.operators import timeseries as ts_
from curbflow.operators.boosting import boosted_trees
from curbflow.sources import landing
from curbflow.sources.scratch import written

from .learning import classification_report, fold_bounds, with_folds
from .registry import query, table
from .sources import landed_predictions
from .spatial import SEGMENTS, places, segments

STATES = ["0", "1", "2"]
SLOTS = 6
FEATURES = ["month", "hour", "day_of_week", "is_weekend", "slot", "tariff_code", "balance", "n_near_0", "n_near_1"]


def answers(spark, sf) -> DataFrame:
    """Each order as an answer of six slots: by the season where it isn't urgent, else by its urgency; the last may be unknown."""
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    season = F.floor((F.month("o_orderdate") - 1) / 4)

    def symbol(i):
        state = F.when(urgency >= 4, F.when(i < 4, season).otherwise(2 - season)).otherwise(urgency - 1)
        return F.when((i == SLOTS - 1) & (F.col("o_orderkey") % 10 == 0), "R").otherwise(state.cast("string"))

    slots = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), symbol), "")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("segment"), F.col("o_orderstatus").alias("tariff"), F.col("o_orderdate").alias("start"), slots.alias("slots")
    )


@query(
    "pipeline_prediction_features",
    f"""WITH {SEGMENTS}, poi AS (SELECT seg, count(*) FILTER (label = 0 AND d <= 0.05) AS n0, count(*) FILTER (label = 1 AND d <= 0.05) AS n1 FROM near GROUP BY 1),
        o AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS u, date_trunc('second', o_orderdate) + to_minutes(CAST(5 * i AS INTEGER)) AS t, CAST(i AS INTEGER) AS slot FROM orders, range({SLOTS}) r(i))
        SELECT o_orderkey AS key, o_custkey AS segment, slot, t AS slot_ts, CAST(CASE WHEN u < 4 THEN u - 1 WHEN slot < 4 THEN (month(o_orderdate) - 1) // 4 ELSE 2 - (month(o_orderdate) - 1) // 4 END AS INTEGER) AS state,
          CAST(month(t) AS INTEGER) AS month, CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS day_of_week, CAST(isodow(t) >= 6 AS INTEGER) AS is_weekend,
          CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS tariff_code, c_acctbal AS balance, coalesce(n0, 0) AS n_near_0, coalesce(n1, 0) AS n_near_1
        FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN poi ON o_custkey = seg
        WHERE NOT (slot = {SLOTS - 1} AND o_orderkey % 10 = 0)""",
)
def prediction_features(spark, sf) -> DataFrame:
    """Answers as they land, one row a known slot, with the clock's features and those of the segment.

    What belongs to a segment is worked out once a segment and joined by its key.
    """
    landed = landing.read_predictions(spark, landed_predictions(spark, answers(spark, sf)), multi_line=False)
    start = F.try_to_timestamp("FH_INICIO", F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz")
    slots = ts_.expand_slots(landed.withColumn("start", start), "start", "PREDICCIONES", drop_unknown=STATES)
    ts = F.col("slot_ts")
    tariff = F.coalesce(*[F.when(F.col("TARIFA") == v, F.lit(i)) for i, v in enumerate("FOP")], F.lit(-1))
    rows = slots.select(
        F.col("TRAMO").cast("long").alias("key"), F.col("ID_TRAMO").cast("long").alias("segment"), "slot", "slot_ts", F.col("symbol").cast("int").alias("state"),
        F.month(ts).alias("month"), F.hour(ts).alias("hour"), temporal.day_of_week(ts).alias("day_of_week"),
        temporal.weekend_flags(ts)["is_weekend"].alias("is_weekend"), tariff.alias("tariff_code"),
    )
    near = sp.category_counts(segments(spark, sf), places(spark, sf).select("label", "x", "y"), "seg", "label", [0, 1], [0.05], unit=1000)
    near = near.select(F.col("seg").alias("segment"), *[F.col(f"poi_{c}_count_50m").alias(f"n_near_{c}") for c in (0, 1)])
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("segment"), F.col("c_acctbal").alias("balance"))
    static = owners.join(near, "segment", "full")
    out = rows.join(static, "segment", "left").na.fill(0, ["n_near_0", "n_near_1"])
    return out.select("key", "segment", "slot", "slot_ts", "state", *[c for c in FEATURES if c != "slot"])


@query("pipeline_prediction_report")
def prediction_report(spark, sf) -> DataFrame:
    """(fold, accuracy, label, precision, recall, f1, support) of boosted trees on expanding time folds; fold null is all tests.

    The last tenth of a fold's training rows says when to stop; test rows are only predicted.
    """
    rows = written(prediction_features(spark, sf))
    order, folds = ["slot_ts", "key", "slot"], 3
    bounds = fold_bounds(rows.count(), folds)
    held = with_folds(rows, order, folds)
    said = None
    for i, (first_test, _) in enumerate(bounds):  # a fixed number of models
        mine = held.where(F.col("fold") == i)
        train = mine.where("part = 'train'").withColumn("tail", F.col("row") >= first_test * 9 // 10)
        model = boosted_trees(train, FEATURES, "state", "tail", rounds=12, rate=0.3, depth=3, patience=3, seed=42 + i)
        test = model.predict(mine.where("part = 'test'")).select("fold", "state", "prediction")
        said = test if said is None else said.unionByName(test)
    said = written(said)
    out = None
    for i in [*range(folds), None]:
        mine = said if i is None else said.where(F.col("fold") == i)
        report = classification_report(mine, "state", "prediction")
        right = mine.agg(F.avg((F.col("state") == F.col("prediction")).cast("double")).alias("accuracy"))
        part = report.join(F.broadcast(right)).select(F.lit(i).cast("int").alias("fold"), "accuracy", *report.columns)  # one row
        out = part if out is None else out.unionByName(part)
    return out
