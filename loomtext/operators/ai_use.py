"""Detector results and grouped AI-use rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mann_whitney
from ..functions.text import c, parse_date, quarter_label, quarter_number, quarter_period, text_features

#: Opinion sections by newspaper.
OPINION_SECTIONS = {
    "de Telegraaf": (["de telegraaf", "telegraaf"], ["watuzegt"]),
    "de Volkskrant": (["de volkskrant", "volkskrant"], ["opinie en debat", "opinie", "opinie zaterdag"]),
}
FEATURES = ["em_dashes_per_1k_words", "quotes_per_1k_words", "quote_word_fraction", "total_words"]


def project_windows(windows: Column | str) -> Column:
    """The three kept fields of each detector window."""
    return F.transform(c(windows), lambda w: F.struct(w["label"].alias("label"), w["ai_assistance_score"].alias("ai_assistance_score"), w["confidence"].alias("confidence")))


def assistance_score(windows: Column | str) -> Column:
    """Mean of the windows' non-null scores; null without any."""
    scores = F.filter(F.transform(c(windows), lambda w: w["ai_assistance_score"]), lambda s: s.isNotNull() & ~F.isnan(s))
    return F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(scores), F.lit(0))


def attach_detector(articles: DataFrame, results: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Articles with detector fields (left join, which may fan out), and the fan-out per key above one."""
    joined = articles.join(results, on, "left")
    fan = results.groupBy(*on).agg(F.count("*").alias("matches")).where("matches > 1")
    return joined, fan


def pending(articles: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Articles without a stored result: the done-key set as an anti join."""
    return articles.join(done.select(*on).distinct(), on, "left_anti")


def build_frame(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows with both fractions and a valid date, with flags, defaults, quarter and text features."""
    both = F.col("fraction_ai").isNotNull() & F.col("fraction_ai_assisted").isNotNull()
    df = df.withColumn("article_date", parse_date(date)).where(both & F.col("article_date").isNotNull())
    return df.withColumns({
        "is_ai_strict": F.col("fraction_ai") == 1,
        "is_ai_broad": (F.col("fraction_ai") > 0) | (F.col("fraction_ai_assisted") > 0),
        "section": F.coalesce(F.nullif("section", F.lit("")), F.lit("Geen Sectie")),
        "predicted_topic": F.coalesce(F.nullif("predicted_topic", F.lit("")), F.lit("Geen Topic")),
        "author": F.coalesce("author", F.array().cast("array<string>")),
        "quarter": quarter_label("article_date"), "quarter_num": quarter_number("article_date"),
        "period": quarter_period("article_date"), "mean_ai_assistance_score": assistance_score("windows"),
        **text_features("full_text"),
    })


def guard_counts(df: DataFrame, date: str = "date") -> DataFrame:
    missing = F.col("fraction_ai").isNull() | F.col("fraction_ai_assisted").isNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(missing).alias("no_score"), F.count_if(~missing & parse_date(date).isNull()).alias("bad_date"))


def long_by_definition(df: DataFrame, strict: str = "is_ai_strict", broad: str = "is_ai_broad") -> DataFrame:
    """Two rows per article: definition and is_ai."""
    pairs = F.array(F.struct(F.lit("strict").alias("d"), F.col(strict).alias("f")), F.struct(F.lit("broad").alias("d"), F.col(broad).alias("f")))
    return df.withColumn("__x", F.explode(pairs)).withColumns({"definition": F.col("__x.d"), "is_ai": F.col("__x.f")}).drop("__x")


def summarize(df: DataFrame, by: list[str], score: str | None = None) -> DataFrame:
    """Totals and AI share per group and definition.

    The two flags are counted in one aggregate and unpivoted after it, so rows are not doubled before the shuffle.
    """
    extra = [F.avg(F.nanvl(F.col(score), F.lit(None))).alias("mean_ai_assistance_score")] if score else []
    wide = df.groupBy(*by).agg(F.count("*").alias("total_articles"), F.count_if("is_ai_strict").alias("__s"), F.count_if("is_ai_broad").alias("__b"), *extra)
    long = long_by_definition(wide, "__s", "__b").withColumnRenamed("is_ai", "ai_articles").drop("__s", "__b")
    names = [e for e in ("mean_ai_assistance_score",) if score]
    return long.select(*by, "definition", "total_articles", "ai_articles", (F.col("ai_articles") / F.col("total_articles")).alias("fraction_ai_use"), *names)


def with_total(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with each row a second time under a total's name (for groups whose totals cannot be rolled up)."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(name))))


def summarize_with_total(df: DataFrame, dataset: str, by: list[str], total: str = "ALL newspapers") -> DataFrame:
    """summarize per dataset and over all of them: counts are rolled up from the datasets' counts."""
    per = df.groupBy(dataset, *by).agg(F.count("*").alias("n"), F.count_if("is_ai_strict").alias("s"), F.count_if("is_ai_broad").alias("b"))
    rolled = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("b").alias("b")).withColumn(dataset, F.lit(total))
    wide = per.unionByName(rolled)
    long = long_by_definition(wide, "s", "b")
    return long.select(dataset, *by, "definition", F.col("n").alias("total_articles"), F.col("is_ai").alias("ai_articles"), (F.col("is_ai") / F.col("n")).alias("fraction_ai_use"))


def explode_authors(df: DataFrame, author: str = "author") -> DataFrame:
    none = F.array(F.lit("NO AUTHOR"))
    return df.withColumn(author, F.explode(F.when(F.coalesce(F.size(author), F.lit(0)) <= 0, none).otherwise(F.col(author))))


def is_opinion(source: Column | str = "source", section: Column | str = "section") -> Column:
    s, sec = F.lower(F.trim(F.coalesce(c(source), F.lit("")))), F.lower(F.trim(F.coalesce(c(section), F.lit(""))))
    out = F.lit(False)
    for names, sections in OPINION_SECTIONS.values():
        out = out | (s.isin(names) & sec.isin(sections))
    return out


def opinion_vs_rest(df: DataFrame, since: float = 2023.0) -> DataFrame:
    s = F.lower(F.trim(F.coalesce(F.col("source"), F.lit(""))))
    paper = F.lit(None)
    for name, (aliases, _) in OPINION_SECTIONS.items():
        paper = F.when(s.isin(aliases), F.lit(name)).otherwise(paper)
    sub = df.withColumn("newspaper", paper).where(F.col("newspaper").isNotNull() & (F.col("quarter_num") >= since))
    return summarize(sub.withColumn("section_group", F.when(is_opinion(), "opinion").otherwise("non-opinion")), ["newspaper", "section_group"])


def topic_shares(df: DataFrame, dataset: str, topic: str, by: list[str] = ()) -> DataFrame:
    """Share of each topic among a dataset's AI articles, per definition; empty groups do not appear."""
    w = Window.partitionBy(dataset, *by, "definition")
    counted = long_by_definition(df).where("is_ai").groupBy(dataset, *by, "definition", topic).agg(F.count("*").alias("ai_articles"))
    return counted.withColumn("total_ai", F.sum("ai_articles").over(w)).withColumn("share", F.col("ai_articles") / F.col("total_ai"))


def recent(df: DataFrame, years: list[int] = (2024, 2025)) -> DataFrame:
    return df.where(F.year("article_date").isin(list(years)))


def stack_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("m"), F.col(f).cast("double").alias("v")) for f in features])
    return df.withColumn("__x", F.explode(pairs)).withColumns({"metric": F.col("__x.m"), "value": F.col("__x.v")}).drop("__x", *features)


def describe_by_flag(df: DataFrame, by: list[str], features: list[str] = FEATURES) -> DataFrame:
    """n, mean and exact median of each feature per flag.

    Equal values are counted first and the counts cumulated, so a group's window holds its different values, sorted and
    spilled by Spark, and no task gathers a group's rows."""
    per = stack_features(df.select(*by, *features), features).where("value is not null").groupBy(*by, "metric", "value").agg(F.count("*").alias("t"))
    w = Window.partitionBy(*by, "metric")
    per = per.withColumns({"upto": F.sum("t").over(w.orderBy("value")), "n": F.sum("t").over(w)})
    low = F.min(F.when(F.col("upto") >= F.floor((F.col("n") + 1) / 2), F.col("value")))
    high = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("value")))
    stats = per.groupBy(*by, "metric").agg(F.max("n").alias("n"), (F.sum(F.col("value") * F.col("t")) / F.max("n")).alias("mean"), ((low + high) / 2).alias("median"))
    pick = lambda m, f: F.max(F.when(F.col("metric") == f, F.col(m)))
    cells = [x for f in features for x in (F.coalesce(pick("n", f), F.lit(0)).alias(f"n_{f}"), pick("mean", f).alias(f"mean_{f}"), pick("median", f).alias(f"median_{f}"))]
    groups = df.select(*by).distinct()  # a group without any value has a row too
    found = stats.groupBy(*by).agg(*cells)
    same = [groups[k].eqNullSafe(found[k]) for k in by]
    out = groups.join(found, same, "left") if by else found
    return out.select(*[groups[k] for k in by], *[F.coalesce(c, F.lit(0)).alias(c) if c.startswith("n_") else c for c in found.columns if c not in by])


def rank_tests(df: DataFrame, by: list[str], flag: str, features: list[str] = FEATURES) -> DataFrame:
    tests = mann_whitney(stack_features(df.select(*by, flag, *features), features), [*by, "metric"], flag, "value")
    return tests.withColumn("significant", F.col("p_value") < 0.05)
