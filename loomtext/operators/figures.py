"""The data behind every figure: one table each, ready to draw.  Nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import c
from .panel import length_trend, timeline
from .sampling import cap_groups


def split_points(splits: DataFrame, group: str = "group", sizes: str = "n_seeds", ai: str = "ai_pct_change", baseline: str = "baseline_pct_change") -> DataFrame:
    """Change of AI-associated and of baseline words, a point per group, list size and word set; pooled rows go."""
    sets = F.array(F.struct(F.lit("ai").alias("word_set"), F.col(ai).alias("pct_change")), F.struct(F.lit("baseline").alias("word_set"), F.col(baseline).alias("pct_change")))
    points = splits.where(F.col(group) != "(pooled)").select(group, sizes, F.explode(sets).alias("x")).select(group, sizes, "x.*")
    return points.where("pct_change is not null")


def spread_lines(sd_panel: DataFrame, sd: str, by: list[str], time: str) -> tuple[DataFrame, DataFrame]:
    """The series of within-group deviations, and its linear trend per group."""
    points = sd_panel.where(F.col(sd).isNotNull()).select(*by, time, sd)
    return points, length_trend(points, sd, time, by)


def slope_histogram(slopes: DataFrame, slope: str = "slope", by: list[str] = (), bins: int = 30) -> DataFrame:
    """Counts of slopes in equal bins between the least and the largest, and whether the bin's middle is below zero."""
    ends = slopes.where(F.col(slope).isNotNull()).groupBy(*by).agg(F.min(slope).alias("lo"), F.max(slope).alias("hi"))
    rows = slopes.where(F.col(slope).isNotNull()).join(F.broadcast(ends), list(by)) if by else slopes.where(F.col(slope).isNotNull()).crossJoin(F.broadcast(ends))  # a row per model
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(width > 0, F.least(F.floor((F.col(slope) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    out = rows.groupBy(*by, "lo", "hi", k.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    middle = F.col("lo") + (F.col("bin") + 0.5) * width
    return out.select(*by, "bin", middle.alias("middle"), "n", (middle < 0).alias("below_zero"))


def sorted_slopes(random: DataFrame, slope: str, by: list[str] = ()) -> DataFrame:
    """Random slopes with their place in rising order, as a caterpillar needs them."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(slope)  # a row per journalist
    return random.where(F.col(slope).isNotNull()).withColumn("place", F.row_number().over(w))


def flagged_label(significant: Column | str, correct: Column | str) -> Column:
    """Three-way label of a flagged-against-others result."""
    return F.when(c(significant) & c(correct), "Sig. (correct dir.)").when(c(significant), "Sig. (wrong dir.)").otherwise("Not significant")


def detector_by_topic(df: DataFrame, score: str, topic: str, date: str, unit: str = "quarter") -> DataFrame:
    """Mean detector score per topic and period, all outlets pooled, with gaps filled."""
    return timeline(df, [topic], date, unit, [score])


def detector_months(df: DataFrame, score: str, outlet: str, date: str) -> DataFrame:
    """Mean detector score and scored articles per outlet and month."""
    rows = df.where(F.col(score).isNotNull() & F.col(date).isNotNull())
    return rows.groupBy(outlet, F.trunc(date, "month").alias("year_month")).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))


def timeline_sets(df: DataFrame, date: str, metrics: list[str], outlet: str = "outlet", outlet_type: str = "outlet_type", topic: str | None = None, units: tuple[str, ...] = ("month", "quarter")) -> dict[tuple[str, str], DataFrame]:
    """Gap-filled timelines by (unit, level): outlet types, outlets, and topics in the range of their outlet."""
    out = {}
    for unit in units:
        out[(unit, "type")] = timeline(df, [outlet_type], date, unit, metrics)
        out[(unit, "outlet")] = timeline(df, [outlet, outlet_type], date, unit, metrics)
        if topic:
            out[(unit, "topic")] = timeline(df, [outlet, topic], date, unit, metrics, [outlet])
    return out


def trajectories(df: DataFrame, metric: str, journalist: str = "journalist_id", keys: list[str] = ("outlet", "outlet_type"), month: str = "year_month", most: int = 50) -> DataFrame:
    """Monthly means of at most ``most`` journalists, drawn in hash order."""
    rows = df.where(F.col(metric).isNotNull() & F.col(journalist).isNotNull())
    return cap_groups(rows, journalist, most).groupBy(journalist, *keys, month).agg(F.avg(metric).alias("metric_mean"), F.count("*").alias("n"))


def forest(effects: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Outlet-type and intervention terms with their 95 % interval."""
    rows = effects.where(F.col("term").rlike("outlet_type|intervention"))
    label = F.trim(F.replace(F.replace("term", F.lit("outlet_type"), F.lit("")), F.lit(":"), F.lit(" × ")))
    return rows.withColumns({"term_clean": label, "conf_low": F.col("estimate") - z * F.col("std_error"), "conf_high": F.col("estimate") + z * F.col("std_error")})
