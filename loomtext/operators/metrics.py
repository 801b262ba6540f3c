"""Per-article style metrics over nested parses.

A parse is array<array<struct<id, text, lemma, upos, feats, deprel, head>>> in one row, so everything except the
lexicon look-up is computed inside the row without a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import c, let, word_count
from ..shared import stored

#: Part-of-speech sets, suffixes, category lemmas and thresholds.
CONTENT = ["NOUN", "VERB", "ADJ", "ADV"]
FUNCTION = {"PRON": "freq_pronoun", "AUX": "freq_aux", "DET": "freq_det", "CCONJ": "freq_cconj", "ADV": "freq_adv", "ADP": "freq_adp"}
SUFFIXES = "(ing|heid|atie|sie|nis|schap|iteit|tie)$"
CATEGORIES = {"care_rigour": ["grondig"], "emphasize": ["benadrukken"], "importance": ["belang"]}
MTLD_MIN, MTLD_THRESHOLD = 50, 0.72
LOW_ZIPF, HIGH_ZIPF, UNSEEN_ZIPF = 3.0, 4.0, 1.0

TOKEN = "struct<id:int,text:string,lemma:string,upos:string,feats:string,deprel:string,head:int>"
PARSE = f"array<array<{TOKEN}>>"


def tokens(parse: Column | str) -> Column:
    return F.flatten(F.coalesce(c(parse), F.array().cast(PARSE)))


def _mean(values: Column) -> Column:
    return let(values, _mean_of)


def _mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def content_lemmas(parse: Column | str) -> Column:
    kept = F.filter(tokens(parse), lambda t: t["upos"].isin(CONTENT) & (F.trim(F.coalesce(t["lemma"], F.lit(""))) != ""))
    return F.transform(kept, lambda t: F.lower(F.trim(t["lemma"])))


def rate(parse: Column | str, test, per: float = 1000.0) -> Column:
    all_ = tokens(parse)
    return F.size(F.filter(all_, test)) * per / F.nullif(F.size(all_), F.lit(0))


def sentence_lengths(parse: Column | str) -> Column:
    return F.transform(c(parse), lambda s: F.size(s).cast("double"))


def variation(values: Column) -> Column:
    """Sample standard deviation over mean; null below two values or for mean 0."""
    m = _mean(values)
    ss = F.aggregate(F.transform(values, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) >= 2, F.sqrt(ss / F.nullif(F.size(values) - 1, F.lit(0))) / F.nullif(m, F.lit(0.0)))


def max_depth(sentence: Column) -> Column:
    """Longest chain of heads.  A chain ends at head 0, at a missing head, or at an id that it has met before."""
    pairs = F.map_from_entries(F.array_distinct(F.transform(sentence, lambda t: F.struct(t["id"], t["head"]))))
    return let(pairs, lambda heads: _deepest(sentence, heads))


def _deepest(sentence: Column, heads: Column) -> Column:
    def chain(t: Column) -> Column:
        start = F.struct(F.lit(0).alias("d"), t["id"].alias("at"), F.array(t["id"]).alias("met"), F.lit(False).alias("end"))

        def step(s: Column, _: Column) -> Column:
            nxt = F.try_element_at(heads, s["at"])
            stop = s["end"] | nxt.isNull() | (nxt == 0) | F.try_element_at(heads, nxt).isNull()
            again = F.coalesce(F.array_contains(s["met"], nxt), F.lit(False))
            return F.when(stop, F.struct(s["d"].alias("d"), s["at"].alias("at"), s["met"].alias("met"), F.lit(True).alias("end"))).otherwise(
                F.struct((s["d"] + 1).alias("d"), nxt.alias("at"), F.concat(s["met"], F.array(nxt)).alias("met"), again.alias("end"))
            )

        return F.aggregate(sentence, start, step, lambda s: s["d"])

    return F.array_max(F.transform(sentence, chain))


def finite_verbs(sentence: Column) -> Column:
    finite = lambda t: t["upos"].isin("VERB", "AUX") & F.coalesce(t["feats"].contains("VerbForm=Fin"), F.lit(False))
    return F.greatest(F.lit(1), F.size(F.filter(sentence, finite)))


def t_unit_length(sentence: Column) -> Column:
    """Tokens over roots and conjuncts of roots."""
    roots = F.transform(F.filter(sentence, lambda t: t["head"] == 0), lambda t: t["id"])
    units = F.size(roots) + F.size(F.filter(sentence, lambda t: (t["deprel"] == "conj") & F.array_contains(roots, t["head"])))
    return F.size(sentence) / F.greatest(F.lit(1), units).cast("double")


def nominalisation_rate(parse: Column | str) -> Column:
    nouns = F.filter(tokens(parse), lambda t: t["upos"] == "NOUN")
    return F.size(F.filter(nouns, lambda t: F.lower(t["lemma"]).rlike(SUFFIXES))) / F.nullif(F.size(nouns), F.lit(0)).cast("double")


def category_rates(parse: Column | str, categories: dict[str, list[str]] = CATEGORIES) -> dict[str, Column]:
    """Each token counts for the first category that holds its lemma."""
    out: dict[str, Column] = {}
    seen: set[str] = set()
    for name, lemmas in categories.items():
        own = [x.lower() for x in lemmas if x.lower() not in seen]
        seen.update(own)
        out[f"{name}_freq_per1k"] = _rate_of(parse, own)
    return out


def _rate_of(parse: Column | str, lemmas: list[str]) -> Column:
    return rate(parse, lambda t: F.coalesce(F.lower(t["lemma"]).isin(lemmas), F.lit(False)))


def mtld_of(words: list[str], threshold: float = MTLD_THRESHOLD) -> float | None:
    """Measure of textual lexical diversity: mean of the forward and the backward pass (McCarthy and Jarvis 2010)."""

    def one(seq) -> float | None:
        factors, types, n = 0.0, set(), 0
        for w in seq:
            n += 1
            types.add(w)
            if len(types) / n < threshold:
                factors += 1
                types, n = set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - threshold)
        return len(words) / factors if factors else None

    if not words:
        return None
    a, b = one(words), one(words[::-1])
    return None if a is None or b is None else (a + b) / 2


@F.pandas_udf(DoubleType())
def mtld(lemmas: pd.Series) -> pd.Series:
    return pd.Series([mtld_of(list(x)) if x is not None and len(x) >= MTLD_MIN else None for x in lemmas], dtype="float64")


def zipf_lexicon(counts: DataFrame, lemma: str = "lemma", count: str = "frequency", order: str | None = None, corpus_size: int | None = None) -> DataFrame:
    """(lemma, zipf): the last count of a lemma wins; counts up to 0 give 1.0.

    Without ``corpus_size`` the counts are stored, since their sum and they themselves are both read."""
    last = F.max_by(count, order) if order else F.last(count)
    kept = counts.where(F.col(count).isNotNull()).groupBy(F.lower(F.trim(lemma)).alias("lemma")).agg(last.alias("n"))
    total = F.lit(corpus_size) if corpus_size else None
    if total is None:
        kept = stored(counts.sparkSession, kept, "lemma-counts")
        kept = kept.crossJoin(F.broadcast(kept.agg(F.sum("n").alias("__total"))))  # a single row
        total = F.col("__total")
    z = F.when(F.col("n") > 0, F.log10(F.col("n") / total * 1e6) + 3).otherwise(1.0)
    return kept.select("lemma", z.alias("zipf"))


def lexical_sophistication(df: DataFrame, key: str, lemmas: str, lexicon: DataFrame, low: float = LOW_ZIPF, high: float = HIGH_ZIPF, broadcast_rows: int = 500_000) -> DataFrame:
    """Shares of rare and common content words and the mean Zipf value of known ones, per key.

    A lexicon of at most ``broadcast_rows`` rows is broadcast and joined word by word, and only sums per article are
    shuffled.  Of a larger one so many of the commonest words are broadcast; only the words that are not among them go
    through a shuffle, counted per article.  The lexicon is stored, since it is read more than once.
    """
    lexicon = stored(df.sparkSession, lexicon.select("lemma", "zipf"), "lexicon")
    words = lexicon.count()
    share = 1 - broadcast_rows / max(words, 1)
    cut = lexicon.agg(F.percentile_approx("zipf", share)).first()[0] if share > 0 else None
    head = lexicon if cut is None else lexicon.where(F.col("zipf") > cut)
    each = df.select(key, F.explode(lemmas).alias("lemma")).join(F.broadcast(head.withColumn("__head", F.lit(True))), "lemma", "left")

    def sums(zipf: str, t: Column) -> dict[str, Column]:
        z = F.coalesce(zipf, F.lit(UNSEEN_ZIPF))
        return {"__n": t, "__low": F.when(z < low, t).otherwise(0), "__high": F.when(z >= high, t).otherwise(0), "__z": F.col(zipf) * t, "__known": F.when(F.col(zipf).isNotNull(), t)}

    total = lambda parts: [F.sum(v).alias(k) for k, v in parts.items()]
    if cut is not None:
        rare = F.col("__head").isNull() & F.col("lemma").isNotNull()
        each = each.groupBy(key, F.when(rare, F.col("lemma")).alias("__word")).agg(*total(sums("zipf", F.lit(1))))
        # an article's sums over the head have a word of their own in place of null, so that they do not meet in one task
        own = F.coalesce("__word", F.xxhash64(key).cast("string"))
        each = each.withColumn("__rare", F.col("__word").isNotNull()).withColumn("__word", own)
        tail = lexicon.where(F.col("zipf") <= cut).select(F.lit(True).alias("__rare"), F.col("lemma").alias("__word"), F.col("zipf").alias("__tail"))
        found = sums("__tail", F.col("__n"))
        each = each.join(tail, ["__rare", "__word"], "left").groupBy(key).agg(*[F.sum(F.when(F.col("__rare"), v).otherwise(F.col(k))).alias(k) for k, v in found.items()])
    else:
        each = each.groupBy(key).agg(*total(sums("zipf", F.lit(1))))
    share_of = lambda c: F.col(c) / F.col("__n")
    mean = F.col("__z") / F.nullif(F.col("__known"), F.lit(0))
    return each.select(key, share_of("__low").alias("prop_low_freq"), share_of("__high").alias("prop_high_freq"), mean.alias("mean_zipf"))


def article_metrics(
    df: DataFrame, parse: str = "parsed_sentences", lexicon: DataFrame | None = None, key: str = "article_id",
    categories: dict[str, list[str]] = CATEGORIES, title: str | None = None, text: Column | None = None, digits: int | None = None,
) -> DataFrame:
    """All metrics of each article; articles without words have totals of 0 and null metrics.

    With ``title`` also word_count_title, with ``text`` (the text that was parsed) also char_count.  ``digits``: rounds
    all metrics."""
    before = set(df.columns)
    p = F.filter(F.coalesce(F.col(parse), F.array().cast(PARSE)), lambda s: F.size(s) > 0)
    df = df.withColumn("__p", p)
    lengths = sentence_lengths("__p")
    df = df.withColumns({
        "total_words": F.size(tokens("__p")), "total_sentences": F.size("__p"), "mtld": mtld(content_lemmas("__p")),
        **{name: rate("__p", _is_upos(u)) for u, name in FUNCTION.items()},
        "mean_sent_len": _mean(lengths), "cv_sent_len": variation(lengths),
        "mean_dep_depth": _mean(F.transform("__p", lambda s: max_depth(s).cast("double"))),
        "finite_verbs_per_sent": _mean(F.transform("__p", lambda s: finite_verbs(s).cast("double"))),
        "mean_tunit_len": _mean(F.transform("__p", t_unit_length)),
        "nom_rate": nominalisation_rate("__p"), **category_rates("__p", categories),
    })
    if lexicon is not None:
        soph = lexical_sophistication(df.withColumn("__l", content_lemmas("__p")), key, "__l", lexicon)
        df = df.join(soph, key, "left")
    if digits is not None:
        df = df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if c not in before and kind == "double"})
    if title is not None:
        df = df.withColumn("word_count_title", word_count(title))
    if text is not None:
        df = df.withColumn("char_count", F.coalesce(F.length(text), F.lit(0)))
    return df.drop("__p")


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, n and mean of each metric over all articles, in one pass."""
    one = df.agg(*[x for m in metrics for x in (F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"m_{m}"))])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"m_{m}").alias("mean")) for m in metrics])
    return one.select(F.explode(cells).alias("x")).select("x.*")


def _is_upos(u: str):
    return lambda t: F.coalesce(t["upos"] == u, F.lit(False))
