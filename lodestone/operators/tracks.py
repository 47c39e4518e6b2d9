"""Movement tracks and series, as windows over (track, time, row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number


def _track(track: str, time: str, row_id: str):
    return Window.partitionBy(track).orderBy(time, row_id)


def _step(x: str, y: str, w) -> Column:
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return F.sqrt(dx * dx + dy * dy)


def calculate_motion_statistics(df: DataFrame, track: str, time: str, x: str, y: str, row_id: str) -> DataFrame:
    """seq, dist, cum_dist, dt, elapsed, speed and accel of every fix (planar); the first is all zeros."""
    w = _track(track, time, row_id)
    out = df.where(F.col(time).isNotNull()).withColumn("seq", F.row_number().over(w).cast("long") - 1)
    out = out.withColumn("dist", F.coalesce(_step(x, y, w), F.lit(0.0))).withColumn("dt", F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0)))
    out = out.withColumn("cum_dist", F.sum("dist").over(w)).withColumn("elapsed", F.col(time) - F.first(time).over(w))
    out = out.withColumn("speed", F.when(F.col("dt") > 0, F.try_divide("dist", "dt")).otherwise(0.0))
    change = F.col("speed") - F.lag("speed").over(w)
    return out.withColumn("accel", F.when((F.col("dt") > 0) & (F.col("seq") > 0), F.try_divide(change, "dt")).otherwise(0.0))


def reconstruct_tracks(df: DataFrame, track: str, time: str, x: str, y: str, row_id: str, time_gap: float | None = None, distance_gap: float | None = None) -> DataFrame:
    """One row per stretch without a gap: n_points, start_t, end_t, duration, length, mean_speed."""
    df, w = df.where(F.col(time).isNotNull()), _track(track, time, row_id)
    out = df.withColumn("_d", _step(x, y, w)).withColumn("_dt", F.col(time) - F.lag(time).over(w))
    cut = F.lit(False)
    if time_gap is not None:
        cut = cut | (F.col("_dt") > time_gap)
    if distance_gap is not None:
        cut = cut | (F.col("_d") > distance_gap)
    out = out.withColumn("_cut", F.coalesce(cut, F.lit(False))).withColumn("segment", F.sum(F.col("_cut").cast("long")).over(w))
    found = out.groupBy(F.col(track).alias("track_id"), "segment").agg(
        F.count("*").alias("n_points"), F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.coalesce(F.sum(F.when(~F.col("_cut"), F.col("_d"))), F.lit(0.0)).alias("length")
    )
    found = found.where("n_points > 1").withColumn("duration", F.col("end_t") - F.col("start_t"))
    return found.withColumn("mean_speed", F.when(F.col("duration") > 0, F.try_divide("length", "duration")).otherwise(0.0))


def time_series_smoothing(df: DataFrame, value: str, time: str, series: str, row_id: str, window: int = 5, alignment: str = "centered", output: str = "smoothed") -> DataFrame:
    """Moving average over rows with a value and a time; partial windows at the ends."""
    before, after = {"centered": ((window - 1) // 2, window // 2), "backward": (window - 1, 0), "forward": (0, window - 1)}[alignment]
    valid = F.col(value).isNotNull() & F.col(time).isNotNull() & F.col(series).isNotNull()
    w = Window.partitionBy(series, valid).orderBy(time, row_id).rowsBetween(-before, after)
    return df.withColumn(output, F.when(valid, F.avg(F.col(value).cast("double")).over(w)))


def detect_incidents(df: DataFrame, track: str, time: str, condition: str, row_id: str, mode: str = "segments") -> DataFrame:
    """Runs of fixes that meet a condition, numbered from 1 over (track, start): as a row each, or with
    ``points`` as their fixes with incident_status start, ongoing or end (a single fix is a start)."""
    df, w = df.where(F.col(time).isNotNull()), _track(track, time, row_id)
    flagged = df.withColumn("_on", F.coalesce(F.expr(condition), F.lit(False)))
    starts = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    ends = F.col("_on") & ~F.coalesce(F.lead("_on").over(w), F.lit(False))
    flagged = flagged.withColumn("_start", starts).withColumn("_end", ends).withColumn("incident_seq", F.sum(F.col("_start").cast("long")).over(w))
    flagged = flagged.where("_on")
    runs = flagged.groupBy(F.col(track).alias("track_id"), "incident_seq")
    found = runs.agg(F.count("*").alias("n_points"), F.min(time).alias("start_t"), F.max(time).alias("end_t")).withColumn("duration", F.col("end_t") - F.col("start_t"))
    found = global_row_number(found, [F.col("track_id"), F.col("incident_seq")], "incident_id")
    if mode == "segments":
        return found
    status = F.when(F.col("_start"), "start").when(F.col("_end"), "end").otherwise("ongoing")
    ids = found.select(F.col("track_id").alias(track), "incident_seq", "incident_id")
    return flagged.withColumn("incident_status", status).join(ids, [track, "incident_seq"]).drop("_on", "_start", "_end")


def collect_events(df: DataFrame, x: str, y: str, row_id: str, tolerance: float = 1e-8) -> DataFrame:
    """Points that round to one cell of ``tolerance``, as its first point with ICOUNT."""
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    cell = df.groupBy(F.round(F.col(x) / tolerance).alias("kx"), F.round(F.col(y) / tolerance).alias("ky"))
    return cell.agg(F.min_by(x, row_id).alias("x"), F.min_by(y, row_id).alias("y"), F.count("*").alias("ICOUNT"))
