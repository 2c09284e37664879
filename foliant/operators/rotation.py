"""Rotated pages: their annotations, records of estimates against the truth, summaries and split checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions.angles import circular_error, normal_angle

PRIVATE_SPLIT = "private_test"


def rotate_items(items: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Items (a struct array with ``polygon``, an array of points) turned with their page and clipped to its new canvas.

    Each keeps its other fields and gets ``polygon`` and ``bbox``; one without an extent afterwards fails the row.
    """
    turn = g.page_rotation(width, height, degrees)

    def point(p: Column) -> Column:
        x, y = turn.apply(p[0], p[1])
        return F.array(F.greatest(F.lit(0.0), F.least(turn.width, x)), F.greatest(F.lit(0.0), F.least(turn.height, y)))

    def turned(item: Column) -> Column:
        made = item.withField("polygon", F.transform(item["polygon"], point))
        box = g.polygon_box(made["polygon"])
        flat = (box[2] - box[0] <= 1e-8) | (box[3] - box[1] <= 1e-8)
        return made.withField("bbox", F.when(flat, F.raise_error(F.lit("an item has no extent after the rotation")).cast("array<double>")).otherwise(box))

    return F.transform(items, turned)


def restored_points(points: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Points of a turned page of that size put back on the page as it was."""
    turn = g.page_rotation(width, height, degrees)
    return F.transform(points, lambda p: F.array(*turn.restore(p[0], p[1])))


def rotate_annotation(df: DataFrame, collections: list[str], width: str, height: str, angle: str, history: str = "transformation_history") -> DataFrame:
    """``df`` with all its collections of items turned together, the page's new size, and one more step in ``history``.

    A step is (type, angle, width, height before), which is what an inverse needs. Null collections stay null.
    """
    w, h, a = (F.col(c).cast("double") for c in (width, height, angle))
    turn = g.page_rotation(w, h, a)
    step = F.struct(F.lit("expanded_rotation").alias("type"), a.alias("angle"), w.alias("width"), h.alias("height"))
    before = F.coalesce(F.col(history), F.array().cast("array<struct<type:string,angle:double,width:double,height:double>>")) if history in df.columns else F.array().cast("array<struct<type:string,angle:double,width:double,height:double>>")
    new = {c: rotate_items(F.col(c), w, h, a) for c in collections}
    # In one projection, lambdas would see the new width and height.
    return df.withColumns({**new, history: F.concat(before, F.array(step))}).withColumns({width: turn.width, height: turn.height})


def evaluation_record(df: DataFrame, truth: str, estimate: str, correction: str, zone: str, predicted_zone: str, zone_confidence: str, confidence: str) -> DataFrame:
    """``df`` with circular_error, residual_angle, zone_correct, combined_confidence, correction_direction_valid and corrected_within_5_degrees.

    Without an estimate, error and residual are null and both flags 0.
    """
    e, t, c = (F.col(x).cast("double") for x in (estimate, truth, correction))
    error = circular_error(e, t)
    right = F.abs(c + normal_angle(e)) <= 1e-9
    return df.withColumns(
        {
            "circular_error": error,
            "residual_angle": normal_angle(t - e),
            "zone_correct": (F.col(zone) == F.col(predicted_zone)).cast("int"),
            "combined_confidence": F.when(F.col(zone_confidence).isNotNull() & F.col(confidence).isNotNull(), F.least(zone_confidence, confidence)).cast("double"),
            "correction_direction_valid": F.coalesce(right, F.lit(False)).cast("int"),
            "corrected_within_5_degrees": F.coalesce(error <= 5.0, F.lit(False)).cast("int"),
        }
    )


def cluster_summary(df: DataFrame, by: list[str], measures: list[str], truth: str, predicted: str) -> DataFrame:
    """(by..., n, wrong, and mean, median, min and max of each measure): one row for each split and cluster."""
    parts = [f(m).alias(f"{m}_{name}") for m in measures for name, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(truth) != F.col(predicted)).alias("wrong"), *parts)


def misclassified(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The rows whose prediction isn't the truth, null predictions included."""
    return df.where(~F.col(truth).eqNullSafe(F.col(predicted)))


def split_violations(df: DataFrame, split: str, private: str, identities: dict[str, str]) -> DataFrame:
    """(problem, value, n) of a split that must not be used; empty where it may be.

    Problems: no split; a private row in a public split, and the other way round; identities
    (label -> column; null and empty ones are none) in several splits, ``n`` being how many.
    """
    s, p = F.col(split), F.coalesce(F.col(private), F.lit(False))
    state = F.when(s.isNull() | (s == ""), "without a split").when(p & (s != PRIVATE_SPLIT), "private in a public split").when(~p & (s == PRIVATE_SPLIT), "public in the private split")
    rows = df.select(state.alias("problem")).where("problem is not null").groupBy("problem").agg(F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    kinds = F.array(*[F.struct(F.lit(f"{label} in several splits").alias("problem"), F.col(c).cast("string").alias("value")) for label, c in identities.items()])
    crossed = df.select(split, F.explode(kinds).alias("x")).select(split, "x.*").where("value is not null and value <> ''")
    crossed = crossed.groupBy("problem", "value").agg(F.count_distinct(split).alias("n")).where("n > 1")
    return rows.unionByName(crossed)
