"""Registered queries over the driver's tables and their DuckDB twins.

Stand-ins: an article is a document, its outlet the source, its topic the language; AI flags are strict = toxic and
broad = toxic or low quality.  Dated panels come from orders: outlet = market segment, topic = order priority,
journalist = customer, metric = total price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import ai_use, inference, junk, metrics, panel, sampling, shift, topics

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import goldens, panels  # noqa: F401  (panels registers its queries here)

    return Q | goldens.Q


def oracle_sql() -> dict[str, str]:
    from . import goldens, panels  # noqa: F401

    return SQL | goldens.SQL


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def r6(c):
    return F.round(c, 6)


# --- AI use --------------------------------------------------------------------------------------------------------


def flagged(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = read(spark, sf_dir, "documents", "doc_id", *columns)
    strict = F.col("toxic") == 1
    return docs.join(labels, "doc_id").withColumns({"is_ai_strict": strict, "is_ai_broad": strict | (F.col("quality") == 0)}).drop("quality", "toxic")


FLAGGED = """f AS (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic = 1 AS s, (l.toxic = 1 OR l.quality = 0) AS b
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 g AS (SELECT *, 'strict' AS definition, s AS is_ai FROM f UNION ALL SELECT *, 'broad', b FROM f)"""
RATE = "count(*) AS total_articles, count(*) FILTER (WHERE is_ai) AS ai_articles, round(count(*) FILTER (WHERE is_ai) * 1.0 / count(*), 6) AS fraction_ai_use"


@query(f"""WITH {FLAGGED}, h AS (SELECT source AS dataset, lang AS topic, definition, is_ai FROM g
 UNION ALL SELECT 'ALL newspapers', lang, definition, is_ai FROM g)
 SELECT dataset, topic, definition, {RATE} FROM h GROUP BY 1, 2, 3""")
def ai_use_by_topic(spark, sf_dir):
    df = flagged(spark, sf_dir, "source", "lang").withColumnsRenamed({"source": "dataset", "lang": "topic"})
    return ai_use.summarize_with_total(df, "dataset", ["topic"]).withColumn("fraction_ai_use", r6("fraction_ai_use"))


@query(f"WITH {FLAGGED} SELECT source, definition, {RATE} FROM g GROUP BY 1, 2")
def ai_use_by_source(spark, sf_dir):
    return ai_use.summarize(flagged(spark, sf_dir, "source"), ["source"]).withColumn("fraction_ai_use", r6("fraction_ai_use"))


@query(f"WITH {FLAGGED} SELECT source, lang, definition, {RATE} FROM g GROUP BY 1, 2, 3")
def ai_use_by_source_lang(spark, sf_dir):
    return ai_use.summarize(flagged(spark, sf_dir, "source", "lang"), ["source", "lang"]).withColumn("fraction_ai_use", r6("fraction_ai_use"))


@query(f"""WITH {FLAGGED}, a AS (SELECT definition, is_ai, unnest(CASE WHEN doc_id % 3 = 0 THEN ['NO AUTHOR']
 WHEN doc_id % 3 = 1 THEN [lang] ELSE [lang, source] END) AS author FROM g)
 SELECT author, definition, {RATE} FROM a GROUP BY 1, 2""")
def ai_use_exploded_authors(spark, sf_dir):
    df = flagged(spark, sf_dir, "source", "lang")
    k = F.col("doc_id") % 3
    authors = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("lang")).otherwise(F.array("lang", "source"))
    df = ai_use.explode_authors(df.withColumn("author", authors))
    return ai_use.summarize(df, ["author"]).withColumn("fraction_ai_use", r6("fraction_ai_use"))


@query(f"""WITH {FLAGGED}, c AS (SELECT source, definition, lang AS topic, count(*) AS ai_articles FROM g WHERE is_ai GROUP BY 1, 2, 3)
 SELECT source, definition, topic, ai_articles, round(ai_articles * 1.0 / sum(ai_articles) OVER (PARTITION BY source, definition), 6) AS share FROM c""")
def topic_share_of_ai(spark, sf_dir):
    df = flagged(spark, sf_dir, "source", "lang").withColumnRenamed("lang", "topic")
    out = ai_use.topic_shares(df, "source", "topic")
    return out.select("source", "definition", "topic", "ai_articles", r6("share").alias("share"))


FEATURES_SQL = r"""w AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')) AS total_words,
 len(regexp_extract_all(text, '—| - ')) AS em_dash_count, regexp_extract_all(text, '"[^"]*"|“[^”]*”') AS q FROM documents)"""


@query(f"""WITH {FEATURES_SQL} SELECT doc_id, total_words, em_dash_count, len(q) AS quote_count,
 coalesce(list_sum(list_transform(q, lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')))), 0)::BIGINT AS quote_word_count,
 round(em_dash_count * 1000.0 / nullif(total_words, 0), 6) AS em_dashes_per_1k_words FROM w""")
def text_features(spark, sf_dir):
    f = text.text_features("text")
    keep = ["total_words", "em_dash_count", "quote_count", "quote_word_count"]
    return read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", *[f[k].cast("long").alias(k) for k in keep], r6(f["em_dashes_per_1k_words"]).alias("em_dashes_per_1k_words")
    )


@query(rf"""WITH {FLAGGED}, w AS (SELECT source, s, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS n FROM f)
 SELECT source, s AS is_ai, count(*) AS n, round(avg(n), 6) AS mean_words, round(quantile_cont(n, 0.5), 6) AS median_words FROM w GROUP BY 1, 2""")
def feature_desc_by_flag(spark, sf_dir):
    df = flagged(spark, sf_dir, "source", "text").withColumn("words", text.unicode_words("text"))
    out = ai_use.describe_by_flag(df, ["source", "is_ai_strict"], ["words"])
    return out.select("source", F.col("is_ai_strict").alias("is_ai"), F.col("n_words").alias("n"), r6("mean_words").alias("mean_words"), r6("median_words").alias("median_words"))


@query(rf"""WITH {FLAGGED}, w AS (SELECT source, s, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS x FROM f),
 r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2.0 AS k,
  count(*) OVER (PARTITION BY source, x) AS t FROM w),
 a AS (SELECT source, count(*) FILTER (WHERE s) AS n1, count(*) FILTER (WHERE NOT s) AS n2, sum(CASE WHEN s THEN k ELSE 0 END) AS r1, sum(t * t - 1) AS tie FROM r GROUP BY 1)
 SELECT source, n1, n2, CASE WHEN n1 >= 2 AND n2 >= 2 THEN r1 - n1 * (n1 + 1) / 2.0 END AS u, tie::DOUBLE AS tie_term FROM a""")
def mann_whitney_u(spark, sf_dir):
    df = flagged(spark, sf_dir, "source", "text").withColumn("x", text.unicode_words("text"))
    return stats.mann_whitney(df, ["source"], "is_ai_strict", "x").select("source", "n1", "n2", "u", "tie_term")


# --- text ----------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents")
def word_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.word_count("text").cast("long").alias("words"))


@query("SELECT page_id, length(concat_ws(' ', nullif(trim(url), ''), nullif(trim(html), ''))) AS n FROM pages")
def text_scope(spark, sf_dir):
    df = read(spark, sf_dir, "pages").withColumnsRenamed({"url": "title", "html": "full_text"}).withColumn("highlight", F.lit(""))
    return df.select("page_id", F.length(text.text_scope("all")).cast("long").alias("n"))


@query("""SELECT doc_id, replace(replace(translate(replace(text, ',,', '"'), '„“”«»＂‘’‚‛', '""\"""\"' || repeat(chr(39), 4)), chr(39) || chr(39), '"'), '``', '"') AS t FROM documents""")
def normalize_quotes(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.normalize_quotes("text").alias("t"))


@query(r"""WITH d AS (SELECT doc_id, lower(text) AS x, text FROM documents)
 SELECT doc_id, len(regexp_extract_all(text, '\S+')) < 50 AS short,
 contains(x, 'colofon') AS colophon, (contains(x, 'horizontaal:') AND contains(x, 'verticaal:')) AS puzzle FROM d""")
def junk_flags(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("title", F.lit(""))
    return d.select("doc_id", junk.is_short("text").alias("short"), junk.is_colophon("title", "text").alias("colophon"), junk.is_puzzle("title", "text").alias("puzzle"))


@query(r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS v FROM documents),
 a AS (SELECT doc_id, count(*) FILTER (WHERE v <> '') AS n, count(*) FILTER (WHERE regexp_matches(v, '^[\d\-*]')) AS m FROM l GROUP BY 1)
 SELECT d.doc_id, coalesce(n > 5 AND m * 2 > n, false) AS enumeration FROM documents d LEFT JOIN a USING (doc_id)""")
def enumeration_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", junk.is_enumeration("text").alias("enumeration"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(d, '(?i)\d{1,2}\s+[a-z]+\s+\d{4}') THEN lpad(regexp_extract(d, '(\d{1,2})\s', 1), 2, '0') || '/' ||
 CASE regexp_extract(d, '\d\s+([a-z]+)', 1) WHEN 'mei' THEN '05' WHEN 'juni' THEN '06' ELSE '01' END || '/2024' ELSE d END AS date
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3 mei 2024' WHEN 1 THEN (doc_id % 28 + 1)::VARCHAR || ' juni 2024' WHEN 2 THEN '7 foo 2024' ELSE 'none' END AS d FROM documents)""")
def dutch_dates(spark, sf_dir):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, "3 mei 2024").when(k == 1, F.concat((F.col("doc_id") % 28 + 1).cast("string"), F.lit(" juni 2024"))).when(k == 2, "7 foo 2024").otherwise("none")
    return read(spark, sf_dir, "documents", "doc_id").withColumn("d", raw).select("doc_id", text.format_date_nl("d").alias("date"))


# --- sampling ------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders),
 i AS (SELECT floor(1.0 + range * (SELECT max(n) FROM o) / 100.0)::BIGINT AS k FROM range(100))
 SELECT o_orderkey FROM o JOIN i USING (k)""")
def systematic_sample(spark, sf_dir):
    return sampling.systematic_sample(read(spark, sf_dir, "orders", "o_orderkey"), 100, "o_orderkey", 1.0)


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id)
 <= floor(count(*) OVER (PARTITION BY lang) * 0.4 + 0.5) THEN 'dev' ELSE 'train' END AS split FROM documents""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(read(spark, sf_dir, "documents", "doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT 50")
def random_sample(spark, sf_dir):
    return sampling.hash_sample(read(spark, sf_dir, "documents", "doc_id"), 50, "doc_id")


# --- topics --------------------------------------------------------------------------------------------------------


def orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderpriority").alias("topic"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("c_mktsegment").alias("outlet"),
    )


ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d, o_orderpriority AS topic, o_totalprice::DECIMAL(18,2) AS price,
 c_mktsegment AS outlet FROM orders JOIN customer ON o_custkey = c_custkey)"""
MONTHLY = "m AS (SELECT outlet, topic, date_trunc('month', d) AS m, count(*) AS n FROM o GROUP BY 1, 2, 3)"


def month():
    return F.date_format("d", "yyyy-MM")


@query(f"""WITH {ORDERS}, {MONTHLY} SELECT outlet, topic, count(*) AS months_present, sum(n)::BIGINT AS total_articles,
 round(avg(n), 6) AS avg_per_month FROM m GROUP BY 1, 2""")
def topic_month_average(spark, sf_dir):
    return topics.topic_averages(orders(spark, sf_dir), "outlet", "topic", month()).withColumn("avg_per_month", r6("avg_per_month"))


@query(f"""WITH {ORDERS}, {MONTHLY}, a AS (SELECT outlet, topic, sum(n) * 1.0 / count(*) AS x FROM m GROUP BY 1, 2),
 t AS (SELECT sum(n) * 1.0 / count(*) AS y FROM m) SELECT o_orderkey FROM o JOIN a USING (outlet, topic) WHERE x >= 8""")
def balanced_rows(spark, sf_dir):
    return topics.balance_topics(orders(spark, sf_dir), 8, "outlet", "topic", month()).select("o_orderkey")


@query(f"""WITH {ORDERS}, {MONTHLY} SELECT outlet, topic, count(*) AS months_present, sum(n)::BIGINT AS total_articles,
 CASE WHEN avg(n) >= 8 THEN 'yes' ELSE 'no' END AS kept FROM m GROUP BY 1, 2""")
def topic_summary(spark, sf_dir):
    out = topics.topic_summary(orders(spark, sf_dir), 8, source="outlet", topic="topic", month=month())
    return out.drop("avg_per_month")


@query("""WITH v AS (SELECT l_orderkey, l_returnflag, round(sum(1.0 / l_linenumber), 9) AS s, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2)
 SELECT l_orderkey, l_returnflag AS head_topic, round(s, 6) AS score FROM v
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, f, l_returnflag) = 1""")
def reciprocal_rank_vote(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn("pos", F.col("l_linenumber") - 1)  # noqa: E741
    return topics.reciprocal_rank_vote(l, "l_orderkey", "pos", "l_returnflag").withColumn("score", r6("score"))


def predictions(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    pred = F.when(F.col("n_chars") % 5 == 0, F.lit(None)).when(F.col("n_chars") % 2 == 0, "en").otherwise(F.col("lang"))
    second = F.when(F.col("doc_id") % 4 == 0, F.lit("de"))
    gold = F.array_distinct(F.filter(F.array("lang", second), lambda x: x.isNotNull()))
    return d.select("doc_id", gold.alias("gold"), pred.alias("pred"))


PRED = """p AS (SELECT doc_id, list_distinct(list_filter([lang, CASE WHEN doc_id % 4 = 0 THEN 'de' END], lambda x: x IS NOT NULL)) AS gold,
 CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 2 = 0 THEN 'en' ELSE lang END AS pred FROM documents)"""


@query(f"""WITH {PRED} SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(list_contains(gold, pred), false)) AS correct,
 round(avg(coalesce(list_contains(gold, pred), false)::INT), 6) AS accuracy FROM p""")
def any_match_accuracy(spark, sf_dir):
    return topics.any_match_accuracy(predictions(spark, sf_dir), "gold", "pred").withColumn("accuracy", r6("accuracy"))


@query(f"""WITH {PRED}, t AS (SELECT doc_id, unnest(gold) AS label FROM p), q AS (SELECT doc_id, pred AS label FROM p WHERE pred IS NOT NULL),
 c AS (SELECT label, count(*) FILTER (WHERE t.doc_id IS NOT NULL AND q.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.doc_id IS NULL) AS fp, count(*) FILTER (WHERE q.doc_id IS NULL) AS fn
  FROM t FULL JOIN q USING (doc_id, label) GROUP BY label), u AS (SELECT * FROM c WHERE tp + fn > 0)
 SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM u""")
def multilabel_f1(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("preds", F.filter(F.array("pred"), lambda x: x.isNotNull()))
    return topics.multilabel_f1(p, "doc_id", "gold", "preds").select(r6("micro_f1").alias("micro_f1"), r6("macro_f1").alias("macro_f1"))


@query(f"""WITH {PRED}, r AS (SELECT unnest(gold) AS gold, coalesce(pred, '<NO_PRED>') AS predicted FROM p), c AS (SELECT gold, predicted, count(*) AS n FROM r GROUP BY 1, 2)
 SELECT gold, predicted, n, round(n * 1.0 / sum(n) OVER (PARTITION BY gold), 6) AS share FROM c""")
def confusion_matrix(spark, sf_dir):
    return topics.confusion(predictions(spark, sf_dir), "gold", "pred", True).withColumn("share", r6("share"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'crime, law and justice' WHEN 1 THEN 'sport' WHEN 2 THEN NULL ELSE 'health' END AS topic FROM documents""")
def parsed_responses(spark, sf_dir):
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, "ID: 1").when(k == 1, "42 is about SPORT").when(k == 2, "99").otherwise("Health news")
    return read(spark, sf_dir, "documents", "doc_id").select("doc_id", topics.parse_response(answer).alias("topic"))


# --- lexicon shift -------------------------------------------------------------------------------------------------


def token_rows(spark, sf_dir) -> DataFrame:
    low = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, sf_dir, "conversations", "role", "text").select("role", F.explode(low).alias("word"))


TOKENS = "k AS (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)"


def scored_words(spark, sf_dir) -> DataFrame:
    c = token_rows(spark, sf_dir).groupBy(F.col("word").alias("key")).agg(F.count_if(F.col("role") == "user").alias("c_H"), F.count_if(F.col("role") == "assistant").alias("c_M"))
    upos = F.when(F.length("key") <= 3, "ADP").otherwise("NOUN")
    k = shift.keyness(c, "c_H", "c_M").withColumns({"upos": upos, "G2": F.round("g2", 6), "LPR": F.round("lpr", 6)})
    return k.select("key", "upos", "G2", "LPR", "c_H", "c_M")


SCORED = f"""{TOKENS}, c AS (SELECT word AS key, count(*) FILTER (WHERE role = 'user') AS c_H, count(*) FILTER (WHERE role = 'assistant') AS c_M FROM k GROUP BY 1),
 n AS (SELECT sum(c_H)::DOUBLE AS n1, sum(c_M)::DOUBLE AS n2 FROM c),
 s AS (SELECT key, c_H, c_M, CASE WHEN length(key) <= 3 THEN 'function' ELSE 'content' END AS category,
  round(2 * (CASE WHEN c_H > 0 THEN c_H * ln(c_H / (n1 * (c_H + c_M) / (n1 + n2))) ELSE 0 END + CASE WHEN c_M > 0 THEN c_M * ln(c_M / (n2 * (c_H + c_M) / (n1 + n2))) ELSE 0 END), 6) AS G2,
  round(log2(((c_M + 0.5) / (n2 + 0.5)) / ((c_H + 0.5) / (n1 + 0.5))), 6) AS LPR FROM c, n WHERE c_H + c_M >= 20),
 ai AS (SELECT category, 'G2' AS method, row_number() OVER (PARTITION BY category ORDER BY G2 DESC, key) AS rank, key FROM s WHERE LPR > 0
  UNION ALL SELECT category, 'LPR', row_number() OVER (PARTITION BY category ORDER BY LPR DESC, key), key FROM s WHERE LPR > 0)"""


@query(f"WITH {SCORED} SELECT category, method, rank, key FROM ai WHERE rank <= 50")
def excess_topk(spark, sf_dir):
    return shift.ai_words(scored_words(spark, sf_dir), 50).select("category", "method", "rank", "key")


@query(f"""WITH {SCORED}, b AS (SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY abs(LPR), key) AS rank FROM s
 WHERE abs(LPR) <= 0.10 AND key NOT IN (SELECT key FROM ai WHERE rank <= 50)) SELECT category, rank, key FROM b WHERE rank <= 50""")
def baseline_words(spark, sf_dir):
    return shift.baseline_words(scored_words(spark, sf_dir), 50).select("category", "rank", "key")


def conversation_counts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(period, key, n) and (period, total): even conversations are before, odd ones after."""
    low = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = read(spark, sf_dir, "conversations", "conv_id", "role", "text").select(F.when(F.col("conv_id") % 2 == 0, "pre").otherwise("post").alias("period"), F.lit("all").alias("scope"), low.alias("w"))
    counts = rows.select("scope", "period", F.explode("w").alias("key")).groupBy("scope", "period", "key").agg(F.count("*").alias("n"))
    return counts, rows.groupBy("scope", "period").agg(F.sum(F.size("w")).alias("total"))


SHIFT = f"""{SCORED}, p AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'pre' ELSE 'post' END AS period, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM conversations),
 t AS (SELECT count(*) FILTER (WHERE period = 'pre')::DOUBLE AS n1, count(*) FILTER (WHERE period = 'post')::DOUBLE AS n2 FROM p),
 pc AS (SELECT key, count(*) FILTER (WHERE period = 'pre') AS pre, count(*) FILTER (WHERE period = 'post') AS post FROM p GROUP BY 1),
 ws AS (SELECT ai.category, ai.method, ai.rank, ai.key, coalesce(pre, 0) AS pre, coalesce(post, 0) AS post, n1, n2 FROM ai LEFT JOIN pc USING (key), t WHERE rank <= 50)"""
CHI = "(n1 + n2) * ({a} * (n2 - {b}) - {b} * (n1 - {a})) * ({a} * (n2 - {b}) - {b} * (n1 - {a})) / nullif(({a} + {b}) * (n1 + n2 - {a} - {b}) * n1 * n2, 0)"


@query(f"""WITH {SHIFT} SELECT category, method, rank, key, pre, post, round(coalesce({CHI.format(a='pre', b='post')}, 0), 4) AS chi2,
 round(CASE WHEN pre > 0 THEN (post / n2 - pre / n1) * 100 / (pre / n1) END, 4) AS pct_change FROM ws""")
def shift_chi2(spark, sf_dir):
    return _word_stats(spark, sf_dir).select("category", "method", "rank", "key", "pre", "post", F.round("chi2", 4).alias("chi2"), F.round("pct_change", 4).alias("pct_change"))


def _word_stats(spark, sf_dir) -> DataFrame:
    words = shift.ai_words(scored_words(spark, sf_dir), 50).select("category", "method", "rank", "key")
    return shift.word_stats(words, *conversation_counts(spark, sf_dir), ["scope"])


@query(f"""WITH {SHIFT}, z AS (SELECT category, method, n AS top_n, sum(pre) AS pre, sum(post) AS post, max(n1) AS n1, max(n2) AS n2, count(*) AS n_words,
  count(*) FILTER (WHERE pre > 0 AND post / n2 > pre / n1) AS n_increasing FROM ws, (SELECT unnest([20, 50]) AS n) x WHERE rank <= n GROUP BY 1, 2, 3)
 SELECT category, method, top_n, pre::BIGINT AS pre, post::BIGINT AS post, n_words, n_increasing, round(coalesce({CHI.format(a='pre', b='post')}, 0), 4) AS chi2 FROM z""")
def shift_summary(spark, sf_dir):
    out = shift.set_summary(_word_stats(spark, sf_dir), ["scope"], ["category", "method"], [20, 50])
    return out.select("category", "method", F.col("top_n").cast("int").alias("top_n"), "pre", "post", "n_words", "n_increasing", F.round("chi2", 4).alias("chi2"))


@query("""WITH p AS (SELECT doc_id, lang, (doc_id % 97) / 97.0 AS p FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS k, count(*) OVER (PARTITION BY lang) AS m FROM p)
 SELECT doc_id, round(least(1.0, min(p * m / k) OVER (PARTITION BY lang ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r
 QUALIFY true""")
def bh_adjust(spark, sf_dir):
    """Pseudo p-values; equal ones have equal results whatever their order."""
    df = read(spark, sf_dir, "documents", "doc_id", "lang").withColumn("p", (F.col("doc_id") % 97) / 97.0)
    return stats.benjamini_hochberg(df, "p", ["lang"], large=True).select("doc_id", r6("p_adj").alias("p_adj"))


SQL["bh_adjust"] = """WITH p AS (SELECT doc_id, lang, (doc_id % 97) / 97.0::DOUBLE AS p FROM documents),
 r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + count(*) OVER (PARTITION BY lang, p) - 1 AS k, count(*) OVER (PARTITION BY lang) AS m FROM p)
 SELECT doc_id, round(least(1.0, min(p * m / k) OVER (PARTITION BY lang ORDER BY k RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r"""


# --- lexicons and sentences ----------------------------------------------------------------------------------------


def _lemmas(spark, sf_dir) -> DataFrame:
    low = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", low.alias("l"))


LEMMAS = """l AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS lemma FROM documents),
 z AS (SELECT lemma, log10(count(*) * 1.0 / (SELECT count(*) FROM l) * 1e6) + 3 AS zipf FROM l GROUP BY 1)"""


@query(f"WITH {LEMMAS} SELECT lemma, round(zipf, 6) AS zipf FROM z")
def zipf_lexicon(spark, sf_dir):
    counts = _lemmas(spark, sf_dir).select(F.explode("l").alias("lemma")).groupBy("lemma").agg(F.count("*").alias("frequency"))
    return metrics.zipf_lexicon(counts, order="lemma").withColumn("zipf", r6("zipf"))


@query(f"""WITH {LEMMAS} SELECT doc_id, round(avg((round(zipf, 9) < 3)::INT), 6) AS prop_low_freq, round(avg((round(zipf, 9) >= 4)::INT), 6) AS prop_high_freq, round(avg(round(zipf, 9)), 5) AS mean_zipf
 FROM l LEFT JOIN z USING (lemma) GROUP BY 1""")
def lex_sophistication(spark, sf_dir):
    l = _lemmas(spark, sf_dir)  # noqa: E741
    counts = l.select(F.explode("l").alias("lemma")).groupBy("lemma").agg(F.count("*").alias("frequency"))
    lexicon = metrics.zipf_lexicon(counts, order="lemma").withColumn("zipf", F.round("zipf", 9))
    out = metrics.lexical_sophistication(l, "doc_id", "l", lexicon)
    # as DuckDB rounds: the scaled double, not its decimal digits (41 of 640 words come out as 0.064062)
    near = lambda c, digits: (F.round(F.col(c) * 10.0**digits) / 10.0**digits).alias(c)
    return out.select("doc_id", near("prop_low_freq", 6), near("prop_high_freq", 6), near("mean_zipf", 5))


@query(r"""WITH s AS (SELECT doc_id, len(regexp_extract_all(unnest(string_split(text, chr(10))), '\S+'))::DOUBLE AS n FROM documents)
 SELECT doc_id, count(*) AS sentences, round(avg(n), 6) AS mean_sent_len, round(stddev_samp(n) / avg(n), 6) AS cv_sent_len FROM s WHERE n > 0 GROUP BY 1""")
def sentence_stats(spark, sf_dir):
    n = F.filter(F.transform(F.split("text", "\n"), lambda s: F.regexp_count(s, F.lit(r"\S+")).cast("double")), lambda v: v > 0)
    d = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("n", n).where(F.size("n") > 0)
    return d.select("doc_id", F.size("n").cast("long").alias("sentences"), r6(metrics._mean(F.col("n"))).alias("mean_sent_len"), r6(metrics.variation(F.col("n"))).alias("cv_sent_len"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey // 20 AS s, (p_partkey % 20 + 1)::INT AS id, ((p_partkey % 20 + 1) // 2)::INT AS head FROM part),
 c AS (SELECT s, id, head, 0 AS d FROM t UNION ALL SELECT c.s, c.id, t.head, c.d + 1 FROM c JOIN t ON t.s = c.s AND t.id = c.head)
 SELECT s, max(d) AS depth FROM c GROUP BY 1""")
def max_depth(spark, sf_dir):
    k = (F.col("p_partkey") % 20 + 1).cast("int")
    t = F.struct(k.alias("id"), F.lit("").alias("text"), F.lit("").alias("lemma"), F.lit("").alias("upos"), F.lit("").alias("feats"), F.lit("").alias("deprel"), F.floor(k / 2).cast("int").alias("head"))
    s = read(spark, sf_dir, "part", "p_partkey").groupBy(F.floor(F.col("p_partkey") / 20).alias("s")).agg(F.collect_list(t).alias("x"))
    return s.select("s", metrics.max_depth(F.col("x")).cast("long").alias("depth"))


# --- panels --------------------------------------------------------------------------------------------------------

SPLIT = "1998-06-01"
MONTHS = "date_diff('day', {a}, {b}) / 30.44"


@query(f"""WITH {ORDERS}, v AS (SELECT o_orderkey, d, date_trunc('month', d)::DATE AS year_month FROM o), f AS (SELECT min(year_month) AS a FROM v)
 SELECT o_orderkey, year_month, trunc({MONTHS.format(a='a', b='year_month')})::INT AS time, (d >= DATE '{SPLIT}')::INT AS intervention,
 CASE WHEN d >= DATE '{SPLIT}' THEN greatest(0, trunc({MONTHS.format(a=f"DATE '{SPLIT}'", b='year_month')})::INT) ELSE 0 END AS time_after FROM v, f""")
def its_variables(spark, sf_dir):
    return panel.its_variables(orders(spark, sf_dir), "d", SPLIT).select("o_orderkey", "year_month", "time", "intervention", "time_after")


@query(f"""WITH {ORDERS}, m AS (SELECT outlet, date_trunc('month', d)::DATE AS year_month, topic, count(*) AS n FROM o GROUP BY 1, 2, 3),
 p AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY outlet, year_month) AS p FROM m)
 SELECT outlet, year_month, round(-sum(p * ln(p + 1e-9)), 6) AS topic_entropy FROM p GROUP BY 1, 2""")
def topic_entropy(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("year_month", F.trunc("d", "month"))
    return panel.topic_entropy(df, ["outlet", "year_month"], "topic").withColumn("topic_entropy", r6("topic_entropy"))


@query(f"""WITH {ORDERS}, m AS (SELECT o_custkey, date_trunc('month', d) AS m, count(*) AS n FROM o GROUP BY 1, 2),
 k AS (SELECT o_custkey FROM m GROUP BY 1 HAVING count(*) >= 8 AND avg(n) >= 1.1) SELECT o_orderkey FROM o JOIN k USING (o_custkey)""")
def journalist_filter(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("year_month", F.trunc("d", "month"))
    return panel.active_journalists(df, "o_custkey", "year_month", 8, 1.1).select("o_orderkey")


@query(f"""WITH {ORDERS} SELECT outlet, year(d) AS year, count(*) AS n_articles, round(stddev_samp(price::DOUBLE), 3) AS sd_price FROM o GROUP BY 1, 2""")
def within_sd_panel(spark, sf_dir):
    df = orders(spark, sf_dir).select("outlet", F.year("d").cast("long").alias("year"), F.col("price").cast("double").alias("price"))
    return panel.within_sd(df, ["price"], ["outlet", "year"]).withColumn("sd_price", F.round("sd_price", 3))


@query(f"""WITH {ORDERS}, m AS (SELECT outlet, year(d) AS year, avg(price::DOUBLE) AS m FROM o GROUP BY 1, 2)
 SELECT year, count(m) AS n_outlets, round(stddev_samp(m), 3) AS cross_sd FROM m GROUP BY 1 HAVING count(m) >= 3""")
def cross_outlet_sd(spark, sf_dir):
    df = orders(spark, sf_dir).select("outlet", F.year("d").cast("long").alias("year"), F.col("price").cast("double").alias("price"))
    return panel.cross_outlet_sd(df, "price", "outlet", "year").withColumn("cross_sd", F.round("cross_sd", 3))


@query(f"""WITH {ORDERS}, s AS (SELECT outlet, count(*) FILTER (WHERE d < DATE '{SPLIT}') AS n1, count(*) FILTER (WHERE d >= DATE '{SPLIT}') AS n2,
  avg(price::DOUBLE) FILTER (d < DATE '{SPLIT}') AS m1, avg(price::DOUBLE) FILTER (d >= DATE '{SPLIT}') AS m2,
  var_samp(price::DOUBLE) FILTER (d < DATE '{SPLIT}') AS v1, var_samp(price::DOUBLE) FILTER (d >= DATE '{SPLIT}') AS v2 FROM o GROUP BY 1)
 SELECT outlet, n1, n2, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
 round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM s""")
def welch_split(spark, sf_dir):
    df = orders(spark, sf_dir).select("outlet", F.col("price").cast("double").alias("price"), F.when(F.col("d") < F.lit(SPLIT).cast("date"), "pre").otherwise("post").alias("period"))
    out = inference.split_ttest(df, ["price"], "period", ["outlet"]).where("scope = 'group'")
    return out.select("outlet", "n1", "n2", r6("t").alias("t"), F.round("df", 4).alias("df"))


@query(f"""WITH {ORDERS}, s AS (SELECT outlet, (d < DATE '{SPLIT}') AS pre, (topic = '1-URGENT')::INT AS hit FROM o),
 g AS (SELECT outlet, sum(CASE WHEN pre THEN hit ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN pre THEN 0 ELSE hit END)::DOUBLE AS b,
  count(*) FILTER (WHERE pre)::DOUBLE AS n1, count(*) FILTER (WHERE NOT pre)::DOUBLE AS n2 FROM s GROUP BY GROUPING SETS ((outlet), ()))
 SELECT coalesce(outlet, 'ALL') AS outlet, a::BIGINT AS a, b::BIGINT AS b, round((n1 + n2) * greatest(abs(a * (n2 - b) - b * (n1 - a)) - (n1 + n2) / 2, 0) ** 2
 / ((a + b) * (n1 + n2 - a - b) * n1 * n2), 6) AS chi2 FROM g""")
def chi2_split_yates(spark, sf_dir):
    df = orders(spark, sf_dir).select("outlet", F.when(F.col("d") < F.lit(SPLIT).cast("date"), "pre").otherwise("post").alias("period"), (F.col("topic") == "1-URGENT").cast("int").alias("hit"), F.lit(1).alias("one"))
    out = inference.split_chi2(df, "hit", "one", "period", ["outlet"])
    return out.select(F.coalesce("outlet", F.lit("ALL")).alias("outlet"), "a", "b", r6("chi2").alias("chi2"))


@query(f"""WITH {ORDERS}, m AS (SELECT outlet, date_diff('month', DATE '1995-01-01', date_trunc('month', d)::DATE)::DOUBLE AS t, (date_trunc('month', d) >= DATE '{SPLIT}') AS post, count(*)::DOUBLE AS n FROM o GROUP BY 1, 2, 3)
 SELECT outlet, CASE WHEN post THEN 'post' ELSE 'pre' END AS period, round(regr_slope(n, t), 6) AS slope, round(regr_intercept(n, t), 6) AS intercept, count(*) AS n_obs
 FROM m GROUP BY 1, 2 HAVING count(*) > 2""")
def prepost_ols(spark, sf_dir):
    month = F.trunc("d", "month")
    t = F.months_between(month, F.lit("1995-01-01").cast("date")).cast("double")
    side = F.when(month >= F.lit(SPLIT).cast("date"), "post").otherwise("pre")
    m = orders(spark, sf_dir).groupBy("outlet", t.alias("t"), side.alias("period")).agg(F.count("*").cast("double").alias("n"))
    return panel.prepost_lines(m, "n", "t", "period", ["outlet"]).select("outlet", "period", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n_obs")


@query(f"""WITH {ORDERS}, l AS (SELECT l_orderkey, avg(l_quantity) AS q FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, outlet, price::DOUBLE AS p, q FROM o LEFT JOIN l ON l_orderkey = o_orderkey),
 s AS (SELECT outlet, avg(p) AS mp, stddev_samp(p) AS sp, avg(q) AS mq, stddev_samp(q) AS sq FROM x GROUP BY 1)
 SELECT o_orderkey, round(CASE WHEN q IS NULL THEN (p - mp) / sp ELSE ((p - mp) / sp - (q - mq) / sq) / 2 END, 5) AS composite FROM x JOIN s USING (outlet)""")
def composite_score(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("q"))  # noqa: E741
    o = orders(spark, sf_dir).withColumn("p", F.col("price").cast("double"))
    x = o.join(l, o.o_orderkey == l.l_orderkey, "left")
    return panel.composite(x, ["p", "q"], "outlet", {"p": 1, "q": -1}).select("o_orderkey", F.round("composite", 5).alias("composite"))


@query("""WITH h AS (SELECT event_type, user_id, date_trunc('day', ts)::DATE AS period, count(*) AS n FROM events GROUP BY 1, 2, 3),
 r AS (SELECT event_type, user_id, min(period) AS a, max(period) AS b FROM h GROUP BY 1, 2),
 g AS (SELECT event_type, user_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS period FROM r)
 SELECT event_type, user_id, period, coalesce(n, 0) AS n_articles FROM g LEFT JOIN h USING (event_type, user_id, period)""")
def gap_filled_timeline(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_type", "ts", "user_id")
    return panel.timeline(e, ["event_type", "user_id"], "ts", "day").select("event_type", "user_id", "period", "n_articles")


@query(f"""WITH {ORDERS}, b AS (SELECT outlet, avg(price::DOUBLE) AS base FROM o WHERE d < DATE '{SPLIT}' GROUP BY 1),
 y AS (SELECT outlet, year(d) AS year, avg(price::DOUBLE) AS v FROM o GROUP BY 1, 2), c AS (SELECT outlet, year, (v - base) * 100 / abs(base) AS x FROM y JOIN b USING (outlet))
 SELECT outlet, year, round(x, 4) AS pct_change, round(avg(x) OVER (PARTITION BY year), 4) AS mean_change FROM c""")
def concept_pct_change(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("p", F.col("price").cast("double"))
    out = panel.concept_change(df, "p", "outlet", "d", SPLIT)
    return out.select("outlet", F.col("year").cast("long").alias("year"), F.round("pct_change", 4).alias("pct_change"), F.round("mean_change", 4).alias("mean_change"))


@query("""SELECT doc_id, CASE WHEN e = 0 THEN 'no hypothesis' WHEN p < 0.05 AND s = e THEN 'significant, expected' WHEN p < 0.05 THEN 'significant, opposite'
 WHEN s = e THEN 'n.s., expected' ELSE 'n.s., opposite' END AS status
 FROM (SELECT doc_id, (doc_id % 20) / 100.0 AS p, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS s,
  CASE doc_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS e FROM documents)""")
def direction_status(spark, sf_dir):
    k = F.col("doc_id") % 4
    metric = F.when(k == 0, "mtld").when(k == 1, "freq_adp").when(k == 2, "something_new").otherwise("baseline_word_20")
    d = read(spark, sf_dir, "documents", "doc_id").withColumns({"p": (F.col("doc_id") % 20) / 100.0, "s": F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1), "e": panel.direction_column(metric)})
    return d.select("doc_id", panel.status_label("p", "s", "e").alias("status"))


@query("""SELECT o_orderpriority AS topic, l_returnflag, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def top_topics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("topic"))
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")  # noqa: E741
    out = panel.top_topics(o.join(l, o.o_orderkey == l.l_orderkey), ["topic"], "l_returnflag", 5)
    return out.select("topic", "l_returnflag", "n", r6("share").alias("share"))
