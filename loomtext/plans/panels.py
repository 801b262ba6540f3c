"""More registered queries over the driver's tables with their DuckDB twins: joins and resume, samples, panels, figures.
The stand-ins are those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ai_use, figures, inference, metrics, panel, sampling, shift
from ..shared import stored
from .catalogue import LEMMAS, ORDERS, SPLIT, _lemmas, flagged, orders, query, r6, read

FLAG_SQL = """f AS (SELECT d.doc_id, d.lang, d.source, l.toxic = 1 AS s, (l.toxic = 1 OR l.quality = 0) AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 g AS (SELECT *, 'strict' AS definition, s AS is_ai FROM f UNION ALL SELECT *, 'broad', b FROM f)"""


#: Averages of cents end in ties of any number of digits; a factor without a short fraction keeps rounding apart from them.
ODD = 0.7310585786300049


def apart(c: str):
    return F.round(F.col(c) * ODD, 4).alias(c)


# --- joins, resume, samples ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, coalesce(l_linenumber, 0) AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def attached_results(spark, sf_dir):
    return _attached(spark, sf_dir)[0].select("o_orderkey", F.coalesce("l_linenumber", F.lit(0)).alias("line"))


@query("SELECT l_orderkey AS o_orderkey, count(*) AS matches FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def attached_fan_out(spark, sf_dir):
    return _attached(spark, sf_dir)[1]


def _attached(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey")
    return ai_use.attach_detector(read(spark, sf_dir, "orders", "o_orderkey"), lines, ["o_orderkey"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_articles(spark, sf_dir):
    return ai_use.pending(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels", "doc_id"), ["doc_id"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark, sf_dir):
    return sampling.first_rows(read(spark, sf_dir, "orders", "o_orderkey"), 100, "o_orderkey")


@query("""WITH c AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5(o_custkey::VARCHAR || '|42'), o_custkey LIMIT 50)
 SELECT o_orderkey, o_custkey FROM orders JOIN c USING (o_custkey)""")
def capped_groups(spark, sf_dir):
    return sampling.cap_groups(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey", 50)


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders),
 i AS (SELECT floor(3.5 + range * (SELECT max(n) FROM o) / 100.0)::BIGINT AS k FROM range(100))
 SELECT o_orderkey, o_custkey, o_orderpriority FROM o JOIN i USING (k)""")
def systematic_rows(spark, sf_dir):
    """Whole rows of a systematic sample."""
    o = read(spark, sf_dir, "orders")
    return sampling.systematic_sample(o, 100, "o_orderkey", 3.5).select("o_orderkey", "o_custkey", "o_orderpriority")


# --- AI use --------------------------------------------------------------------------------------------------------


@query(f"""WITH {FLAG_SQL}, n AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'de Telegraaf' WHEN 1 THEN 'de Volkskrant' END AS newspaper,
  CASE WHEN (doc_id % 3 = 0 AND lang = 'en') OR (doc_id % 3 = 1 AND lang = 'de') THEN 'opinion' ELSE 'non-opinion' END AS section_group FROM g WHERE doc_id % 2 = 1)
 SELECT newspaper, section_group, definition, count(*) AS total_articles, count(*) FILTER (WHERE is_ai) AS ai_articles, round(count(*) FILTER (WHERE is_ai) * 1.0 / count(*), 6) AS fraction_ai_use
 FROM n WHERE newspaper IS NOT NULL GROUP BY 1, 2, 3""")
def opinion_by_newspaper(spark, sf_dir):
    k, lang = F.col("doc_id") % 3, F.col("lang")
    df = flagged(spark, sf_dir, "lang").withColumns({
        "source": F.when(k == 0, " De Telegraaf").when(k == 1, "volkskrant").otherwise("ed"),
        "section": F.when((k == 0) & (lang == "en"), "WATUZEGT").when((k == 1) & (lang == "de"), " Opinie").otherwise("Sport"),
        "quarter_num": F.when(F.col("doc_id") % 2 == 1, 2023.25).otherwise(2022.75),
    })
    return ai_use.opinion_vs_rest(df).withColumn("fraction_ai_use", r6("fraction_ai_use"))


@query(f"""WITH {FLAG_SQL} SELECT source, definition, count(*) AS total_articles, count(*) FILTER (WHERE is_ai) AS ai_articles,
 round(count(*) FILTER (WHERE is_ai) * 1.0 / count(*), 6) AS fraction_ai_use, round(avg(CASE WHEN doc_id % 4 > 0 THEN doc_id % 10 / 10.0 END), 6) AS mean_ai_assistance_score FROM g WHERE lang = 'en' GROUP BY 1, 2""")
def section_summary(spark, sf_dir):
    """One section's articles by source, with the mean detector score of those that have one."""
    df = flagged(spark, sf_dir, "source", "lang").where("lang = 'en'").withColumn("score", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 10 / 10.0))
    out = ai_use.summarize(df, ["source"], "score")
    return out.withColumns({k: r6(k) for k in ("fraction_ai_use", "mean_ai_assistance_score")})


@query(f"WITH {ORDERS} SELECT o_orderkey FROM o WHERE year(d) IN (1996, 1997)")
def recent_rows(spark, sf_dir):
    return ai_use.recent(orders(spark, sf_dir).withColumn("article_date", F.col("d")), [1996, 1997]).select("o_orderkey")


@query(f"""WITH f AS (SELECT event_type, avg(value) AS a, avg(value * 2) AS b FROM events GROUP BY 1)
 SELECT event_type, fraction, round(mean * {ODD}::DOUBLE, 4) AS mean FROM (UNPIVOT f ON a, b INTO NAME fraction VALUE mean)""")
def fraction_mix(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "value").withColumns({"a": F.col("value"), "b": F.col("value") * 2})
    return panel.fraction_mix(e, ["event_type"], ["a", "b"]).withColumn("mean", apart("mean"))


# --- lexicon shift -------------------------------------------------------------------------------------------------

_WORDS = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"
_KEYED = f"""k AS (SELECT role, CASE WHEN conv_id % 2 = 0 THEN 'pre' ELSE 'post' END AS period, {_WORDS} AS w FROM conversations),
 x AS (SELECT role, period, w || CASE WHEN length(w) <= 3 THEN '_ADP' ELSE '_NOUN' END AS key FROM k WHERE length(w) <> 5)"""


def _parsed(spark, sf_dir) -> DataFrame:
    """Conversations as parses of one sentence; words of five letters are punctuation."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    upos = lambda w: F.when(F.length(w) == 5, "PUNCT").when(F.length(w) <= 3, "ADP").otherwise("NOUN")
    none = F.lit(None).cast("string")
    token = lambda w: F.struct(F.lit(1).alias("id"), w.alias("text"), F.concat(F.lit(" "), F.upper(w)).alias("lemma"), upos(w).alias("upos"), none.alias("feats"), none.alias("deprel"), F.lit(0).alias("head"))
    c = read(spark, sf_dir, "conversations", "conv_id", "role", "text")
    return c.select(F.col("role").alias("source"), F.when(F.col("conv_id") % 2 == 0, "pre").otherwise("post").alias("period"), F.array(F.transform(words, token)).alias("parsed_sentences"))


def _tracked(spark) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ("the_ADP", "and_ADP", "that_NOUN", "with_NOUN", "zzz_ADP")], "key string")


_TRACKED = "key IN ('the_ADP', 'and_ADP', 'that_NOUN', 'with_NOUN', 'zzz_ADP')"


@query(f"WITH {_KEYED} SELECT role AS source, period, key, count(*) AS n FROM x WHERE {_TRACKED} GROUP BY 1, 2, 3")
def tracked_token_counts(spark, sf_dir):
    return shift.token_counts(_parsed(spark, sf_dir), _tracked(spark))[0]


@query(f"WITH {_KEYED} SELECT role AS source, period, count(*) AS total FROM x GROUP BY 1, 2")
def token_totals(spark, sf_dir):
    return shift.token_counts(_parsed(spark, sf_dir), _tracked(spark))[1].withColumn("total", F.col("total").cast("long"))


@query(f"""WITH {_KEYED}, c AS (SELECT role, CASE WHEN role = 'system' THEN 'a' ELSE 'b' END AS grp, period, key FROM x WHERE {_TRACKED})
 SELECT CASE WHEN grouping(role) = 0 THEN 'paper' WHEN grouping(grp) = 0 THEN 'group' ELSE 'overall' END AS scope_kind, coalesce(role, grp, 'overall') AS scope, period, key, count(*) AS n
 FROM c GROUP BY GROUPING SETS ((period, key), (grp, period, key), (role, period, key))""")
def rolled_up_counts(spark, sf_dir):
    counts = shift.token_counts(_parsed(spark, sf_dir), _tracked(spark))[0].withColumn("group", F.when(F.col("source") == "system", "a").otherwise("b"))
    return shift.roll_up(counts, "n", ["period", "key"])


@query("""WITH c AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
 x AS (SELECT conv_id, CASE w WHEN 'the' THEN 2.0 WHEN 'that' THEN 0.5 END AS lpr FROM c)
 SELECT conv_id, count(lpr) AS focal_count, round(count(lpr) * 1000.0 / count(*), 6) AS focal_ratio, round(coalesce(sum(lpr), 0) * 1000.0 / count(*), 6) AS focal_weighted FROM x GROUP BY 1""")
def focal_word_rates(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id", "text")
    none = F.lit(None).cast("string")
    token = lambda w: F.struct(F.lit(1).alias("id"), w.alias("text"), w.alias("lemma"), F.lit("X").alias("upos"), none.alias("feats"), none.alias("deprel"), F.lit(0).alias("head"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    each = c.select("conv_id", F.array(F.transform(words, token)).alias("parsed_sentences"))
    out = shift.focal_rates(each, "conv_id", spark.createDataFrame([("the_X", 2.0), ("that_X", 0.5)], "key string, LPR double"))
    return out.select("conv_id", F.col("focal_count").cast("long").alias("focal_count"), r6("focal_ratio").alias("focal_ratio"), r6("focal_weighted").alias("focal_weighted"))


@query("""WITH p AS (SELECT p_partkey, p_brand AS scope, CASE WHEN p_partkey % 5 = 0 THEN 'baseline' ELSE 'G2' END AS method, p_partkey % 30 + 1 AS rank, 'content' AS category, (p_partkey % 11)::DOUBLE AS pre, (p_partkey % 13)::DOUBLE AS post FROM part),
 w AS (SELECT *, CASE WHEN pre <> 0 THEN (post - pre) * 100.0 / pre END AS change FROM p),
 z AS (SELECT scope, method, n AS top_n, sum(pre) AS pre, sum(post) AS post, avg(change) AS mc, median(change) AS dc, count(*) AS n_words, count(*) FILTER (WHERE change > 0) AS up
  FROM w, (SELECT unnest([20, 50]) AS n) x WHERE rank <= n GROUP BY 1, 2, 3),
 c AS (SELECT *, CASE WHEN pre <> 0 THEN (post - pre) * 100.0 / pre END AS sc FROM z)
 SELECT a.scope, a.method, a.top_n, round(a.mc, 6) AS mean_word_change, round(a.dc, 6) AS median_word_change, a.n_words, a.up AS n_increasing, round(a.sc, 6) AS set_change, coalesce(a.sc > b.sc, false) AS above_baseline
 FROM c a LEFT JOIN c b ON b.scope = a.scope AND b.top_n = a.top_n AND b.method = 'baseline'""")
def set_changes(spark, sf_dir):
    """Mean and median word change of ranked lists, and whether a list rose more than the baseline words."""
    k = F.col("p_partkey")
    words = read(spark, sf_dir, "part", "p_partkey", "p_brand").select(
        F.col("p_brand").alias("scope"), F.when(k % 5 == 0, "baseline").otherwise("G2").alias("method"), (k % 30 + 1).alias("rank"), F.lit("content").alias("category"),
        (k % 11).cast("double").alias("pre"), (k % 13).cast("double").alias("post"), F.lit(1e6).alias("pre_total"), F.lit(1e6).alias("post_total"),
    )
    words = words.withColumn("pct_change", F.when(F.col("pre") != 0, (F.col("post") - F.col("pre")) * 100.0 / F.col("pre")))
    out = shift.above_baseline(shift.set_summary(words, ["scope"], ["category", "method"], [20, 50]), ["scope"])
    return out.select("scope", "method", F.col("top_n").cast("int").alias("top_n"), r6("mean_word_change").alias("mean_word_change"), r6("median_word_change").alias("median_word_change"), "n_words", "n_increasing", r6("set_change").alias("set_change"), F.coalesce("above_baseline", F.lit(False)).alias("above_baseline"))


@query(f"""WITH {LEMMAS}, k AS (SELECT lemma, zipf FROM z WHERE lemma < 'n')
 SELECT count(*) AS words, count(zipf) AS known, round(avg(coalesce(zipf, 1.0)), 5) AS mean_zipf FROM l LEFT JOIN k USING (lemma)""")
def lexicon_cover(spark, sf_dir):
    """Zipf values of half of the words, unseen ones rated lowest, over all texts: what the lexical join is made of."""
    l = _lemmas(spark, sf_dir)  # noqa: E741
    counts = stored(spark, l.select(F.explode("l").alias("lemma")).groupBy("lemma").agg(F.count("*").alias("frequency")), "lemmas")
    lexicon = metrics.zipf_lexicon(counts, order="lemma").where("lemma < 'n'")
    return counts.join(lexicon, "lemma", "left").agg(
        F.sum("frequency").alias("words"), F.sum(F.when(F.col("zipf").isNotNull(), F.col("frequency"))).alias("known"),
        F.round(F.sum(F.coalesce("zipf", F.lit(1.0)) * F.col("frequency")) / F.sum("frequency"), 5).alias("mean_zipf"),
    )


# --- panels --------------------------------------------------------------------------------------------------------


def _priced(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).withColumn("p", F.col("price").cast("double"))


@query(f"""WITH {ORDERS}, f AS (SELECT min(date_trunc('month', d))::DATE AS a FROM o)
 SELECT o_orderkey, trunc(date_diff('day', a, date_trunc('month', d)::DATE) / 30.44)::INT AS time, CASE WHEN d >= DATE '{SPLIT}' THEN 'post' ELSE 'pre' END AS period, outlet || '::' || topic AS journalist_id
 FROM o, f WHERE price >= 150000""")
def preprocessed(spark, sf_dir):
    out = panel.preprocess(_priced(spark, sf_dir), 150_000, "p", "d", "topic", intervention=SPLIT)
    return out.select("o_orderkey", "time", "period", "journalist_id")


@query("""SELECT * FROM (SELECT 'text' AS "column", round(count(text) * 100.0 / count(*), 6) AS coverage_pct FROM documents
 UNION ALL SELECT 'lang', round(count(lang) * 100.0 / count(*), 6) FROM documents UNION ALL SELECT 'even', round(count(*) FILTER (WHERE doc_id % 2 = 0) * 100.0 / count(*), 6) FROM documents)""")
def coverage_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumns({"even": F.when(F.col("doc_id") % 2 == 0, 1), "total_words": F.length("text"), "time": F.col("doc_id"), "outlet": F.lit(1), "period": F.lit("pre")})
    return panel.quality_checks(d, ["text", "lang", "even"])["coverage"].withColumn("coverage_pct", r6("coverage_pct"))


def _checks(spark, sf_dir) -> dict[str, DataFrame]:
    df = panel.its_variables(_priced(spark, sf_dir), "d", SPLIT).withColumn("words", F.floor(F.col("p") / 1000).cast("int"))
    return panel.quality_checks(df, ["topic"], "words", topic="topic")


@query(f"""WITH {ORDERS}, w AS (SELECT floor(price / 1000)::INT AS x FROM o)
 SELECT min(x) AS min, quantile_cont(x, 0.25) AS q1, median(x) AS median, round(avg(x), 6) AS mean, quantile_cont(x, 0.75) AS q3, max(x) AS max FROM w""")
def length_summary(spark, sf_dir):
    return _checks(spark, sf_dir)["lengths"].withColumn("mean", r6("mean"))


@query(f"""WITH {ORDERS} SELECT outlet, count(*) FILTER (WHERE d < DATE '{SPLIT}') AS pre, count(*) FILTER (WHERE d >= DATE '{SPLIT}') AS post FROM o GROUP BY 1""")
def period_balance(spark, sf_dir):
    return _checks(spark, sf_dir)["balance"].select("outlet", "pre", "post")


@query(f"""WITH {ORDERS}, f AS (SELECT min(date_trunc('month', d))::DATE AS a FROM o), w AS (SELECT floor(price / 1000)::DOUBLE AS y, trunc(date_diff('day', a, date_trunc('month', d)::DATE) / 30.44)::DOUBLE AS x FROM o, f)
 SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r_squared, count(*) AS n_obs FROM w""")
def length_trend(spark, sf_dir):
    return _checks(spark, sf_dir)["length_trend"].select(r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r_squared").alias("r_squared"), "n_obs")


@query(f"""WITH {ORDERS}, c AS (SELECT outlet, CASE WHEN d < DATE '{SPLIT}' THEN 'pre' ELSE 'post' END AS period, topic, count(*) AS n FROM o GROUP BY 1, 2, 3)
 SELECT outlet, period, topic, n, round(n * 1.0 / sum(n) OVER (PARTITION BY outlet, period), 6) AS share, row_number() OVER (PARTITION BY outlet, period ORDER BY n DESC, topic) AS rank FROM c QUALIFY rank <= 5""")
def period_topics(spark, sf_dir):
    return _checks(spark, sf_dir)["top_topics"].withColumn("share", r6("share"))


@query(f"""WITH {ORDERS}, m AS (SELECT outlet, date_trunc('month', d)::DATE AS year_month, topic, count(*) AS n, sum(price)::DOUBLE AS s FROM o GROUP BY 1, 2, 3),
 p AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY outlet, year_month) AS p FROM m)
 SELECT outlet, year_month, sum(n)::BIGINT AS n_articles, round(sum(s) / sum(n) * {ODD}::DOUBLE, 4) AS p, round(sum(s) * 2 / sum(n) * {ODD}::DOUBLE, 4) AS mean_words, round(-sum(p * ln(p + 1e-9)), 6) AS topic_entropy FROM p GROUP BY 1, 2""")
def full_outlet_panel(spark, sf_dir):
    df = _priced(spark, sf_dir).withColumns({"year_month": F.trunc("d", "month"), "words": F.col("p") * 2})
    out = panel.outlet_month_panel(df, ["p"], ["outlet", "year_month"], "words", "topic")
    return out.select("outlet", "year_month", "n_articles", apart("p"), apart("mean_words"), r6("topic_entropy").alias("topic_entropy"))


@query(f"""WITH {ORDERS}, m AS (SELECT outlet, topic, year(d) AS year, avg(price::DOUBLE) AS v FROM o GROUP BY 1, 2, 3)
 SELECT outlet, year, round(avg(v) * {ODD}::DOUBLE, 4) AS mean, round(stddev_samp(v) / sqrt(count(v)), 4) AS se, count(v) AS n FROM m GROUP BY 1, 2""")
def composite_means(spark, sf_dir):
    m = _priced(spark, sf_dir).groupBy("outlet", "topic", F.year("d").cast("long").alias("year")).agg(F.avg("p").alias("v"))
    return panel.composite_by_type(m, ["outlet", "year"], "v").select("outlet", "year", apart("mean"), F.round("se", 4).alias("se"), "n")


@query("""WITH s AS (SELECT c_acctbal::DOUBLE AS x FROM customer), r AS (SELECT x, row_number() OVER (ORDER BY abs(x) DESC) AS r, count(*) OVER () AS n FROM s),
 a AS (SELECT count(*) AS n_journalists, sum(CASE WHEN r <= greatest(1, floor(n * 0.1 + 0.5)) THEN abs(x) ELSE 0 END) * 100 / sum(abs(x)) AS t, avg((x > 0)::INT) * 100 AS e FROM r)
 SELECT n_journalists, round(t, 6) AS top10_share, round(e, 6) AS pct_expected, CASE WHEN t > 50 THEN 'concentrated' WHEN t > 33 THEN 'moderate' ELSE 'broad' END AS label FROM a""")
def slope_concentration(spark, sf_dir):
    s = read(spark, sf_dir, "customer", "c_acctbal").select(F.col("c_acctbal").cast("double").alias("slope"))
    return panel.concentration(s).withColumns({"top10_share": r6("top10_share"), "pct_expected": r6("pct_expected")})


@query(f"""WITH {ORDERS}, s AS (SELECT (topic = '1-URGENT') AS f, price::DOUBLE AS x FROM o),
 a AS (SELECT count(*) FILTER (WHERE NOT f) AS n1, count(*) FILTER (WHERE f) AS n2, avg(x) FILTER (NOT f) AS m1, avg(x) FILTER (f) AS m2, var_samp(x) FILTER (NOT f) AS v1, var_samp(x) FILTER (f) AS v2 FROM s)
 SELECT n1, n2, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((m2 - m1) * 100 / abs(m1), 6) AS pct_change FROM a""")
def flagged_against_others(spark, sf_dir):
    df = _priced(spark, sf_dir)
    out = inference.compare_flagged(df, df.where("topic = '1-URGENT'"), ["o_orderkey"], ["p"])
    return out.select("n1", "n2", r6("t").alias("t"), r6("pct_change").alias("pct_change"))


@query("SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49) ON l_orderkey = o_orderkey")
def flagged_rows(spark, sf_dir):
    flags = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity >= 49").withColumnRenamed("l_orderkey", "o_orderkey")
    return panel.flagged_audit(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), flags, ["o_orderkey"])


@query(f"""WITH {ORDERS}, f AS (SELECT min(date_trunc('month', d))::DATE AS a FROM o),
 m AS (SELECT outlet, date_trunc('month', d)::DATE AS ym, avg(price::DOUBLE) AS y FROM o GROUP BY 1, 2),
 s AS (SELECT outlet, y, trunc(date_diff('day', a, ym) / 30.44)::DOUBLE AS x, row_number() OVER (PARTITION BY outlet ORDER BY ym) AS i FROM m, f),
 b AS (SELECT outlet, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2 FROM s GROUP BY 1),
 e AS (SELECT s.outlet, i, y - b0 - b1 * x AS g0, x * (y - b0 - b1 * x) AS g1 FROM s JOIN b USING (outlet)),
 l AS (SELECT u.outlet, CASE WHEN u.i = v.i THEN 1.0 ELSE 2.0 * (1 - (u.i - v.i) / 4.0) END AS w, u.g0 AS a0, u.g1 AS a1, v.g0 AS c0, v.g1 AS c1 FROM e u JOIN e v ON u.outlet = v.outlet AND u.i - v.i BETWEEN 0 AND 3),
 k AS (SELECT outlet, sum(w * a0 * c0) AS s00, sum(w * a1 * c1) AS s11, sum(w * (a0 * c1 + a1 * c0) / 2) AS s01 FROM l GROUP BY 1),
 r AS (SELECT outlet, b1, r2, n, -sx / (n * sxx - sx * sx) AS p, n / (n * sxx - sx * sx) AS q, s00, s01, s11 FROM b JOIN k USING (outlet))
 SELECT outlet, round(b1, 4) AS estimate, round(sqrt((p * p * s00 + 2 * p * q * s01 + q * q * s11) * n / (n - 2)), 4) AS std_error, n::BIGINT AS n_obs, round(r2, 6) AS r_squared FROM r""")
def newey_west_its(spark, sf_dir):
    """Trends of monthly prices per outlet with Newey-West errors of lag 3."""
    df = panel.its_variables(_priced(spark, sf_dir), "d", SPLIT)
    months = df.groupBy("outlet", "year_month").agg(F.avg("p").alias("p"), F.max("time").alias("time"))
    out = inference.its(months.withColumn("order", F.col("year_month")), ["p"], ["outlet"], [], steps=["time"]).where("term = 'time'")
    return out.select("outlet", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"), "n_obs", r6("r_squared").alias("r_squared"))


@query()
def segmented_its(spark, sf_dir):
    """Segmented regression of monthly prices per outlet with robust errors (rows only)."""
    df = panel.its_variables(_priced(spark, sf_dir), "d", SPLIT)
    by = ["outlet", "year_month", "time", "intervention", "time_after"]
    months = df.groupBy("outlet", "year_month").agg(F.avg("p").alias("p"), F.count("*").cast("double").alias("mean_words"), F.max("time").alias("time"), F.max("intervention").alias("intervention"), F.max("time_after").alias("time_after"))
    out = inference.its(months.select(*by, "p", "mean_words"), ["p"], ["outlet"])
    return out.select("outlet", "metric", "term", "estimate", "std_error", "p_value", "p_adj", "n_obs")


# --- figures -------------------------------------------------------------------------------------------------------


@query(f"""WITH {ORDERS}, s AS (SELECT outlet, year(d) AS year, stddev_samp(price::DOUBLE) AS sd FROM o GROUP BY 1, 2)
 SELECT outlet, round(regr_slope(sd, year), 4) AS slope, count(*) AS n_obs FROM s WHERE sd IS NOT NULL GROUP BY 1""")
def spread_trend(spark, sf_dir):
    sds = panel.within_sd(_priced(spark, sf_dir).withColumn("year", F.year("d")), ["p"], ["outlet", "year"])
    return figures.spread_lines(sds, "sd_p", ["outlet"], "year")[1].select("outlet", F.round("slope", 4).alias("slope"), "n_obs")


@query("""WITH s AS (SELECT c_mktsegment, c_acctbal::DOUBLE AS x FROM customer), e AS (SELECT c_mktsegment, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1),
 b AS (SELECT c_mktsegment, lo, hi, least(floor((x - lo) / ((hi - lo) / 30)), 29)::INT AS bin FROM s JOIN e USING (c_mktsegment))
 SELECT c_mktsegment, bin, round(lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 30), 4) AS middle, count(*) AS n, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 30) < 0 AS below_zero FROM b GROUP BY c_mktsegment, bin, lo, hi""")
def slope_histogram(spark, sf_dir):
    s = read(spark, sf_dir, "customer", "c_mktsegment", "c_acctbal").withColumn("slope", F.col("c_acctbal").cast("double"))
    return figures.slope_histogram(s, "slope", ["c_mktsegment"]).withColumn("middle", F.round("middle", 4))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 1000003) AS place FROM customer")
def sorted_slopes(spark, sf_dir):
    s = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").withColumn("slope", ((F.col("c_custkey") * 7919) % 1000003).cast("double"))
    return figures.sorted_slopes(s, "slope", ["c_mktsegment"]).select("c_custkey", "place")


@query(f"""WITH m AS (SELECT event_type, date_trunc('month', ts)::DATE AS year_month, avg(value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
 SELECT event_type, year_month, round(v * {ODD}::DOUBLE, 4) AS mean_score, n FROM m""")
def detector_months(spark, sf_dir):
    return figures.detector_months(read(spark, sf_dir, "events", "event_type", "ts", "value"), "value", "event_type", "ts").withColumn("mean_score", apart("mean_score"))


_GAPS = """r AS (SELECT {keys}, min(period) AS a, max(period) AS b FROM h GROUP BY {keys}),
 g AS (SELECT {keys}, unnest(generate_series(a, b, INTERVAL 3 MONTH))::DATE AS period FROM r)"""


@query(f"""WITH {ORDERS}, h AS (SELECT topic, date_trunc('quarter', d)::DATE AS period, count(*) AS n, avg(price::DOUBLE) AS v FROM o GROUP BY 1, 2), {_GAPS.format(keys='topic')}
 SELECT topic, period, coalesce(n, 0) AS n_articles, round(v * {ODD}::DOUBLE, 4) AS p FROM g LEFT JOIN h USING (topic, period)""")
def detector_by_topic(spark, sf_dir):
    return figures.detector_by_topic(_priced(spark, sf_dir), "p", "topic", "d").withColumn("p", apart("p"))


@query(f"""WITH {ORDERS}, t AS (SELECT * FROM o WHERE (o_orderkey + year(d)) % 3 = 0), h AS (SELECT outlet, topic, date_trunc('quarter', d)::DATE AS period, count(*) AS n, avg(price::DOUBLE) AS v FROM t GROUP BY 1, 2, 3),
 {_GAPS.format(keys='outlet')}, u AS (SELECT DISTINCT outlet, topic FROM h)
 SELECT outlet, topic, period, coalesce(n, 0) AS n_articles, round(v * {ODD}::DOUBLE, 4) AS p FROM u JOIN g USING (outlet) LEFT JOIN h USING (outlet, topic, period)""")
def topic_timelines(spark, sf_dir):
    df = _priced(spark, sf_dir).where((F.col("o_orderkey") + F.year("d")) % 3 == 0).withColumn("outlet_type", F.lit("x"))
    return figures.timeline_sets(df, "d", ["p"], topic="topic")[("quarter", "topic")].withColumn("p", apart("p"))


@query(f"""WITH {ORDERS}, h AS (SELECT outlet, substr(outlet, 1, 1) AS outlet_type, date_trunc('month', d)::DATE AS period, count(*) AS n, avg(price::DOUBLE) AS v FROM o GROUP BY 1, 2, 3),
 r AS (SELECT outlet, outlet_type, min(period) AS a, max(period) AS b FROM h GROUP BY 1, 2), g AS (SELECT outlet, outlet_type, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS period FROM r)
 SELECT outlet, outlet_type, period, coalesce(n, 0) AS n_articles, round(v * {ODD}::DOUBLE, 4) AS p FROM g LEFT JOIN h USING (outlet, outlet_type, period)""")
def outlet_timelines(spark, sf_dir):
    df = _priced(spark, sf_dir).withColumn("outlet_type", F.substring("outlet", 1, 1))
    return figures.timeline_sets(df, "d", ["p"])[("month", "outlet")].withColumn("p", apart("p"))


@query(f"""WITH {ORDERS}, c AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM o) ORDER BY md5(o_custkey::VARCHAR || '|42'), o_custkey LIMIT 50)
 SELECT o_custkey, outlet, date_trunc('month', d)::DATE AS year_month, round(avg(price::DOUBLE) * {ODD}::DOUBLE, 4) AS metric_mean, count(*) AS n FROM o JOIN c USING (o_custkey) GROUP BY 1, 2, 3""")
def journalist_trajectories(spark, sf_dir):
    df = _priced(spark, sf_dir).withColumn("year_month", F.trunc("d", "month"))
    return figures.trajectories(df, "p", "o_custkey", ["outlet"]).withColumn("metric_mean", apart("metric_mean"))


@query(f"""SELECT metric, n, round(mean * {ODD}::DOUBLE, 4) AS mean FROM (SELECT 'quantity' AS metric, count(l_quantity) AS n, avg(l_quantity) AS mean FROM lineitem
 UNION ALL SELECT 'odd', count(*) FILTER (WHERE l_linenumber % 2 = 1), avg(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) FROM lineitem)""")
def metric_means(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem", "l_quantity", "l_linenumber")  # noqa: E741
    l = l.select(F.col("l_quantity").cast("double").alias("quantity"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("double")).alias("odd"))  # noqa: E741
    return metrics.metric_summary(l, ["quantity", "odd"]).withColumn("mean", apart("mean"))
