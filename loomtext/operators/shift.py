"""Lexicon shift: word sets from scored lists, pre/post token counts, rates and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, chi2_2x2, chi2_p, pct_change, ppm, stars
from ..functions.text import c

#: Periods, part-of-speech sets and list sizes.
PRE, POST = ("2021-01-01", "2022-11-30"), ("2024-01-01", "2025-12-31")
CATEGORIES = {"content": ["NOUN", "VERB", "ADJ", "ADV"], "function": ["ADP", "DET", "PRON", "SCONJ", "CCONJ", "AUX"]}
EXCLUDED_UPOS = ["PUNCT", "SYM", "X", "_SP"]
TOP_N = [20, 50, 100, 200]
BASELINE_CAP, MIN_COUNT = 0.10, 20
PAPER_GROUPS = {
    "de Telegraaf": "national", "de Volkskrant": "national", "Dagblad van het Noorden": "regional",
    "Eindhovens Dagblad": "regional", "Steenwijker Courant": "local", "Nieuwsblad Noordoost-Friesland": "local",
}


def assert_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def period_of(date: Column | str, pre: tuple[str, str] = PRE, post: tuple[str, str] = POST) -> Column:
    """pre, post, or null in the gap and outside."""
    d = c(date)
    return F.when(d.between(*[F.lit(x).cast("date") for x in pre]), "pre").when(d.between(*[F.lit(x).cast("date") for x in post]), "post")


def keyness(counts: DataFrame, h: str = "c_h", m: str = "c_m") -> DataFrame:
    """Dunning's G2 and a smoothed log ratio of two corpora's counts (m over h)."""
    totals = counts.agg(F.sum(h).alias("__nh"), F.sum(m).alias("__nm"))  # a single row
    df = counts.crossJoin(F.broadcast(totals))
    a, b, n1, n2 = (F.col(x).cast("double") for x in (h, m, "__nh", "__nm"))
    e1, e2 = n1 * (a + b) / (n1 + n2), n2 * (a + b) / (n1 + n2)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    lpr = F.log2(((b + 0.5) / (n2 + 0.5)) / ((a + 0.5) / (n1 + 0.5)))
    return df.withColumns({"g2": 2 * (part(a, e1) + part(b, e2)), "lpr": lpr}).drop("__nh", "__nm")


def pool(words: DataFrame, minimum: int = MIN_COUNT) -> DataFrame:
    """Scored words with a category by their part of speech and enough counts."""
    category = F.when(F.col("upos").isin(CATEGORIES["content"]), "content").when(F.col("upos").isin(CATEGORIES["function"]), "function")
    return words.withColumn("category", category).where(F.col("category").isNotNull() & (F.col("c_H") + F.col("c_M") >= minimum))


def ranked(df: DataFrame, order: list[Column], n: int, by: str = "category") -> DataFrame:
    """The first n rows of each group with their rank; Spark prunes the groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def ai_words(words: DataFrame, n: int = max(TOP_N), row: str = "key") -> DataFrame:
    """The n words with the largest G2, and with the largest LPR, among those with LPR > 0: method, rank, key."""
    up = pool(words).where("LPR > 0")
    lists = [ranked(up, [F.desc(m), F.asc(row)], n).withColumn("method", F.lit(m)) for m in ("G2", "LPR")]
    return lists[0].unionByName(lists[1])


def baseline_words(words: DataFrame, n: int = max(TOP_N), row: str = "key") -> DataFrame:
    """The n words with the smallest |LPR| up to the cap that no AI list holds."""
    near = pool(words).where(F.abs("LPR") <= BASELINE_CAP).join(ai_words(words, n, row).select("key").distinct(), "key", "left_anti")
    return ranked(near, [F.abs("LPR").asc(), F.asc(row)], n)


def token_counts(articles: DataFrame, keys: DataFrame | None, paper: str = "source", parse: str = "parsed_sentences", period: str = "period") -> tuple[DataFrame, DataFrame]:
    """(paper, period, key, n) of tracked keys, and (paper, period, total) of all countable tokens.

    Tokens are filtered in their arrays before they are exploded; keys are a bounded list, which Spark broadcasts by
    its size.
    """
    good = lambda t: ~F.coalesce(t["upos"], F.lit("X")).isin(EXCLUDED_UPOS) & (F.trim(F.coalesce(t["lemma"], F.lit(""))) != "")
    key = lambda t: F.concat(F.lower(F.trim(t["lemma"])), F.lit("_"), t["upos"])
    listed = articles.where(F.col(period).isNotNull()).select(paper, period, F.transform(F.filter(F.flatten(parse), good), key).alias("k"))
    totals = listed.groupBy(paper, period).agg(F.sum(F.size("k")).alias("total"))
    each = listed.select(paper, period, F.explode("k").alias("key"))
    if keys is not None:  # before counting: no other key is shuffled
        each = each.join(keys.select("key").distinct(), "key", "left_semi")
    return each.groupBy(paper, period, "key").agg(F.count("*").alias("n")), totals


def roll_up(df: DataFrame, value: str, by: list[str], paper: str = "source", group: str = "group") -> DataFrame:
    """Sums over all papers, per group and per paper: scope_kind, scope."""
    g = df.groupingSets([[*by], [group, *by], [paper, *by]], group, paper, *by) if hasattr(df, "groupingSets") else None
    out = g.agg(F.sum(value).alias(value), F.grouping_id().alias("__g"))
    kind = F.when(F.col(paper).isNotNull(), "paper").when(F.col(group).isNotNull(), "group").otherwise("overall")
    return out.select(kind.alias("scope_kind"), F.coalesce(paper, group, F.lit("overall")).alias("scope"), *by, value)


def word_stats(words: DataFrame, counts: DataFrame, totals: DataFrame, scope: list[str]) -> DataFrame:
    """Pre and post counts, rates, change and test of every listed word per scope.

    ``counts`` is (scope, period, key, n), ``totals`` (scope, period, total).
    """
    wide = counts.groupBy(*scope, "key").pivot("period", ["pre", "post"]).agg(F.sum("n"))
    tot = totals.groupBy(*scope).pivot("period", ["pre", "post"]).agg(F.sum("total")).withColumnsRenamed({"pre": "pre_total", "post": "post_total"})
    grid = words.crossJoin(tot.na.fill(0))  # listed words and scopes are both bounded lists
    df = grid.join(wide, [*scope, "key"], "left").na.fill(0, ["pre", "post", "pre_total", "post_total"])
    chi = chi2_2x2(F.col("pre"), F.col("post"), F.col("pre_total"), F.col("post_total"))
    pre_ppm, post_ppm = ppm("pre", "pre_total"), ppm("post", "post_total")
    return df.withColumns({"pre_ppm": pre_ppm, "post_ppm": post_ppm, "pct_change": pct_change(pre_ppm, post_ppm), "chi2": chi})


def set_summary(stats: DataFrame, scope: list[str], by: list[str], top: list[int] = TOP_N) -> DataFrame:
    """Of the first N words of each list: set rates, change, test, and how many words rose."""
    sizes = F.explode(F.filter(F.array(*[F.lit(n) for n in top]), lambda n: n >= F.col("rank"))).alias("top_n")
    df = stats.select("*", sizes)
    agg = df.groupBy(*scope, *by, "top_n").agg(
        F.sum("pre").alias("pre"), F.sum("post").alias("post"), F.max("pre_total").alias("pre_total"), F.max("post_total").alias("post_total"),
        F.avg("pct_change").alias("mean_word_change"), F.percentile("pct_change", F.lit(0.5)).alias("median_word_change"),
        F.count_if(F.col("pct_change") > 0).alias("n_increasing"), F.count("*").alias("n_words"),
    )
    pre_ppm, post_ppm = ppm("pre", "pre_total"), ppm("post", "post_total")
    return agg.withColumns({
        "pre_ppm": pre_ppm, "post_ppm": post_ppm, "set_change": pct_change(pre_ppm, post_ppm),
        "chi2": chi2_2x2(F.col("pre"), F.col("post"), F.col("pre_total"), F.col("post_total")),
    })


def above_baseline(summary: DataFrame, scope: list[str], method: str = "method", baseline: str = "baseline") -> DataFrame:
    """summary with whether each list's rate rose more than that of the baseline words of its category and size."""
    base = summary.where(F.col(method) == baseline).select(*scope, "category", "top_n", F.col("set_change").alias("baseline_change"))
    return summary.join(base, [*scope, "category", "top_n"], "left").withColumn("above_baseline", F.col("set_change") > F.col("baseline_change"))


def with_tests(summary: DataFrame, within: list[str]) -> DataFrame:
    """p-values, BH-adjusted within the scope, and stars."""
    df = summary.withColumn("p_value", chi2_p("chi2"))
    df = benjamini_hochberg(df, "p_value", within, "p_adj")
    return df.withColumns({"reject": F.col("p_adj") <= 0.05, "stars": stars("p_adj")})


def focal_rates(articles: DataFrame, key: str, words: DataFrame, parse: str = "parsed_sentences") -> DataFrame:
    """Per article: share, count and LPR-weighted share per 1000 tokens of listed words (columns of words: key, LPR)."""
    tok = F.explode(F.transform(F.flatten(parse), lambda t: F.concat(F.lower(F.trim(t["lemma"])), F.lit("_"), t["upos"])))
    each = articles.select(F.col(key), tok.alias("key")).groupBy(key, "key").agg(F.count("*").alias("t"))
    total = F.sum("t")
    return each.join(words.select("key", "LPR"), "key", "left").groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("LPR").isNotNull(), F.col("t"))), F.lit(0)).alias("focal_count"),
        (F.coalesce(F.sum(F.when(F.col("LPR").isNotNull(), F.col("t"))), F.lit(0)) * 1000.0 / total).alias("focal_ratio"),
        (F.coalesce(F.sum(F.col("LPR") * F.col("t")), F.lit(0.0)) * 1000.0 / total).alias("focal_weighted"),
    )
