"""Monthly panels, gap-filled timelines, composites and homogenisation series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import c

INTERVENTION = "2022-12-01"
#: Metrics and the direction expected of AI-like text.
DIRECTIONS = {
    "mtld": -1, "prop_low_freq": -1, "prop_high_freq": 1, "mean_zipf": 1, "freq_pronoun": 1, "freq_aux": 1, "freq_det": 1,
    "freq_cconj": 1, "freq_adv": -1, "freq_adp": 0, "mean_sent_len": -1, "cv_sent_len": -1, "mean_dep_depth": -1,
    "finite_verbs_per_sent": -1, "mean_tunit_len": -1, "nom_rate": 1, "care_rigour_freq_per1k": 1,
    "emphasize_freq_per1k": 1, "importance_freq_per1k": 1,
}
#: Outlets.
OUTLETS = [
    ("vk", "De Volkskrant", "national", 1), ("tgf", "De Telegraaf", "national", 1),
    ("dvhn", "Dagblad van het Noorden", "regional", 2), ("ed", "Eindhovens Dagblad", "regional", 2),
    ("stc", "Steenwijker Courant", "local", 3), ("nof", "Nieuwsblad Noordoost-Friesland", "local", 3),
]
_FOCAL = re.compile(r"^(llm_style_word|baseline_word)_.*")


def outlets(spark) -> DataFrame:
    return spark.createDataFrame(OUTLETS, "outlet string, outlet_name string, outlet_type string, type_order int")


def metric_columns(columns: list[str]) -> list[str]:
    """Fingerprint metrics, category rates and focal ratios among the columns."""
    return [k for k in columns if k in DIRECTIONS or k.endswith("_freq_per1k") or _FOCAL.match(k)]


def direction(metric: str) -> int:
    """Of a metric; baseline columns have none, everything unknown is expected to rise."""
    return DIRECTIONS.get(metric, 0 if metric.startswith("baseline_word_") else 1)


def direction_column(metric: Column | str) -> Column:
    m = c(metric)
    out = F.when(m.rlike("^baseline_word_"), 0).otherwise(1)
    for value in (-1, 0, 1):
        out = F.when(m.isin([k for k, v in DIRECTIONS.items() if v == value]), value).otherwise(out)
    return out


def metric_label(metric: str) -> str:
    return metric.replace("_freq_per1k", " (per 1,000)").replace("freq_", "").replace("_", " ").capitalize()


def its_variables(df: DataFrame, date: str = "article_date", intervention: str = INTERVENTION, exact_months: bool = False) -> DataFrame:
    """year_month, time, intervention, time_after and period of each row.

    Month numbers are truncated days / 30.44; ``exact_months`` counts calendar months instead.  The first month comes
    from a one-row aggregate, not from a window over all rows.
    """
    df = df.where(F.col(date).isNotNull()).withColumn("year_month", F.trunc(date, "month"))
    first = F.broadcast(df.agg(F.min("year_month").alias("__first")))  # a single row
    at = F.lit(intervention).cast("date")
    start = F.trunc(at, "month")
    months = (lambda a, b: F.months_between(b, a).cast("int")) if exact_months else (lambda a, b: (F.datediff(b, a) / 30.44).cast("int"))
    after = F.col(date) >= at
    return df.crossJoin(first).withColumns({
        "time": months(F.col("__first"), F.col("year_month")), "intervention": after.cast("int"),
        "time_after": F.when(after, F.greatest(F.lit(0), months(start, F.col("year_month")))).otherwise(0),
        "period": F.when(after, "post").otherwise("pre"),
    }).drop("__first")


def preprocess(df: DataFrame, min_words: int = 50, words: str = "total_words", date: str = "article_date", author: str = "author", outlet: str = "outlet", **options) -> DataFrame:
    """Rows with a date and at least ``min_words`` words, with the segmented-regression variables and journalists."""
    return journalists(its_variables(df, date, **options).where(F.col(words) >= min_words), author, outlet)


def journalists(df: DataFrame, author: str = "author", outlet: str = "outlet", keep_missing: bool = True) -> DataFrame:
    """First author and journalist id; rows without an author are one journalist NA of their outlet, or null."""
    name = F.nullif(F.trim(F.split(F.col(author), ";")[0]), F.lit(""))
    shown = F.coalesce(name, F.lit("NA")) if keep_missing else name
    return df.withColumns({"author_clean": name, "journalist_id": F.when(shown.isNotNull(), F.concat(F.col(outlet), F.lit("::"), shown))})


def active_journalists(df: DataFrame, journalist: str = "journalist_id", month: str = "year_month", min_months: int = 24, min_mean: float = 3) -> DataFrame:
    """Rows of journalists active in enough months with enough articles per active month."""
    monthly = df.groupBy(journalist, month).agg(F.count("*").alias("n"))
    kept = monthly.groupBy(journalist).agg(F.count("*").alias("months"), F.avg("n").alias("mean")).where((F.col("months") >= min_months) & (F.col("mean") >= min_mean))
    return df.join(kept.select(journalist), journalist, "left_semi")


def topic_entropy(df: DataFrame, by: list[str], topic: str) -> DataFrame:
    counts = df.where(F.col(topic).isNotNull()).groupBy(*by, topic).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-9))).alias("topic_entropy"))


def outlet_month_panel(df: DataFrame, metrics: list[str], by: list[str], words: str = "total_words", topic: str | None = None) -> DataFrame:
    """Articles, mean words and metric means per group, with topic entropy where a topic is given."""
    panel = df.groupBy(*by).agg(F.count("*").alias("n_articles"), F.avg(words).alias("mean_words"), *[F.avg(m).alias(m) for m in metrics])
    return panel.join(topic_entropy(df, by, topic), by, "left") if topic else panel


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null values per column, in one pass."""
    one = df.agg(F.count("*").alias("__n"), *[F.count(k).alias(k) for k in columns])
    pairs = F.array(*[F.struct(F.lit(k).alias("column"), (F.col(k) * 100.0 / F.nullif("__n", F.lit(0))).alias("coverage_pct")) for k in columns])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def quality_checks(df: DataFrame, columns: list[str], words: str = "total_words", time: str = "time", outlet: str = "outlet", period: str = "period", topic: str | None = None) -> dict[str, DataFrame]:
    """Coverage of columns, summary and trend of lengths, articles per outlet and period (one column a period), and the
    top five topics per outlet and period."""
    lengths = df.groupBy(F.col(words)).agg(F.count("*").alias("__t")).where(F.col(words).isNotNull())  # lengths are few
    weighted = lambda p: F.expr(f"percentile({words}, {p}, __t)")
    out = {
        "coverage": quality_report(df, columns),
        "lengths": lengths.agg(
            F.min(words).alias("min"), weighted(0.25).alias("q1"), weighted(0.5).alias("median"),
            (F.sum(F.col(words) * F.col("__t")) / F.sum("__t")).alias("mean"), weighted(0.75).alias("q3"), F.max(words).alias("max"),
        ),
        "length_trend": length_trend(df, words, time),
        "balance": df.groupBy(outlet).pivot(period, ["pre", "post"]).agg(F.count(F.lit(1))),
    }
    if topic:
        out["top_topics"] = top_topics(df, [outlet, period], topic)
    return out


def length_trend(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.regr_count(y, x).alias("n_obs"))


def top_topics(df: DataFrame, by: list[str], topic: str, n: int = 5) -> DataFrame:
    counts = df.groupBy(*by, topic).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), topic))
    return counts.withColumns({"share": share, "rank": rank}).where(F.col("rank") <= n)


def within_sd(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_articles"), *[F.stddev_samp(m).alias(f"sd_{m}") for m in metrics])


def cross_outlet_sd(df: DataFrame, metric: str, outlet: str, month: str, minimum: int = 3) -> DataFrame:
    """Standard deviation of outlet means per month with enough outlets."""
    means = df.groupBy(outlet, month).agg(F.avg(metric).alias("m"))
    out = means.groupBy(month).agg(F.count("m").alias("n_outlets"), F.stddev_samp("m").alias("cross_sd"))
    return out.where(F.col("n_outlets") >= minimum)


def composite(df: DataFrame, metrics: list[str], outlet: str = "outlet", directions: dict[str, int] | None = None) -> DataFrame:
    """Mean over metrics of direction times z-score within the outlet; null metrics are skipped.

    Means and deviations come from an aggregate per outlet and are joined back: a small table instead of a window
    that would gather all rows of an outlet.
    """
    signs = {m: (directions or {}).get(m, direction(m)) for m in metrics}
    used = [m for m in metrics if signs[m]]
    stats = df.groupBy(outlet).agg(*[x for m in used for x in (F.avg(m).alias(f"__m_{m}"), F.stddev_samp(m).alias(f"__s_{m}"))])
    z = [signs[m] * (F.col(m) - F.col(f"__m_{m}")) / F.nullif(F.col(f"__s_{m}"), F.lit(0.0)) for m in used]
    kept = F.filter(F.array(*z), lambda v: v.isNotNull())
    score = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(kept), F.lit(0))
    names = [k for k in stats.columns if k.startswith("__")]
    return df.join(stats, outlet).withColumn("composite", score).drop(*names)


def timeline(df: DataFrame, by: list[str], date: str, unit: str = "month", metrics: list[str] = (), range_by: list[str] | None = None) -> DataFrame:
    """Means per group and period with every period of the group's range present; n is 0 and means are null in gaps.

    ``range_by``: the coarser group that sets the range (the outlet's for topics in an outlet).
    """
    range_by = by if range_by is None else range_by
    floor = df.where(F.col(date).isNotNull()).withColumn("period", F.date_trunc(unit, date).cast("date"))
    have = floor.groupBy(*by, "period").agg(F.count("*").alias("n_articles"), *[F.avg(m).alias(m) for m in metrics])
    step = {"day": "1 day", "month": "1 month", "quarter": "3 month", "year": "1 year"}[unit]
    span = have.groupBy(*range_by).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    ticks = span.select(*range_by, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("period"))
    groups = have.select(*by).distinct()
    grid = groups.join(ticks, range_by) if range_by else groups.crossJoin(ticks)
    return grid.join(have, [*by, "period"], "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))


def concept_change(df: DataFrame, metric: str, outlet: str, date: str, split: str = INTERVENTION) -> DataFrame:
    """Yearly percentage change of outlet means from their pre-period baseline, with the mean over outlets."""
    base = df.where(F.col(date) < F.lit(split).cast("date")).groupBy(outlet).agg(F.avg(metric).alias("baseline"))
    yearly = df.groupBy(outlet, F.year(date).alias("year")).agg(F.avg(metric).alias("value"))
    out = yearly.join(base, outlet).withColumn("pct_change", (F.col("value") - F.col("baseline")) * 100 / F.abs("baseline"))
    return out.withColumn("mean_change", F.avg("pct_change").over(Window.partitionBy("year")))


def composite_by_type(df: DataFrame, by: list[str], value: str = "composite") -> DataFrame:
    n = F.count(value)
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("se"), n.alias("n"))


def fraction_mix(df: DataFrame, by: list[str], fractions: list[str] = ("fraction_ai", "fraction_ai_assisted", "fraction_human")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(f).alias(f) for f in fractions]).unpivot(list(by), list(fractions), "fraction", "mean")


def prepost_lines(df: DataFrame, y: str, time: str, period: str, by: list[str]) -> DataFrame:
    """Least-squares line of each side with more than two points."""
    return length_trend(df, y, time, [*by, period]).where("n_obs > 2")


def status_label(p: Column | str, sign: Column | str, expected: Column | str) -> Column:
    """Four-way label of a result against its hypothesis."""
    sig = c(p) < 0.05
    hit = c(sign) == c(expected)
    return F.when(c(expected) == 0, "no hypothesis").when(sig & hit, "significant, expected").when(sig, "significant, opposite").when(hit, "n.s., expected").otherwise("n.s., opposite")


def flagged_audit(df: DataFrame, flagged: DataFrame, on: list[str]) -> DataFrame:
    return df.join(flagged.select(*on).distinct(), on)


def concentration(slopes: DataFrame, slope: str = "slope", expected: int = 1) -> DataFrame:
    """Share of the absolute slopes that the top tenth holds, share in the expected direction, and a label."""
    w = Window.orderBy(F.desc(F.abs(slope)))  # one row per journalist of one model: a result table
    n = F.floor(F.count("*").over(Window.partitionBy(F.lit(1))) * 0.1 + 0.5)
    r = slopes.where(F.col(slope).isNotNull()).withColumns({"__r": F.row_number().over(w), "__top": F.greatest(F.lit(1), n)})
    share = F.sum(F.when(F.col("__r") <= F.col("__top"), F.abs(slope)).otherwise(0.0)) * 100 / F.sum(F.abs(slope))
    out = r.agg(F.count("*").alias("n_journalists"), share.alias("top10_share"), (F.avg((F.signum(slope) == expected).cast("int")) * 100).alias("pct_expected"))
    return out.withColumn("label", F.when(F.col("top10_share") > 50, "concentrated").when(F.col("top10_share") > 33, "moderate").otherwise("broad"))
