"""Hand-computed expectations of the stylometry operators."""

import io
import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.functions import stats, text
from loomtext.operators import ai_use, backends, extract, inference, junk, metrics, panel, sampling, shift, topics
from loomtext.sources import files, schemas
from loomtext.streaming import landing


def one(spark, expr, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items()))
    return df.select(expr.alias("x")).first().x


# --- text ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [("1 januari 2024", "01/01/2024"), ("12 Mei 2023 zaterdag", "12/05/2023"), ("3 foo 2020", "03/01/2020"), ("none", "none"), ("", "")])
def test_dutch_date(spark, raw, want):
    assert one(spark, text.format_date_nl("t"), t=raw) == want


@pytest.mark.parametrize("raw, want", [("31/02/2020", None), ("1/2/2020", "2020-02"), ("", None), (None, None)])
def test_year_month(spark, raw, want):
    assert one(spark, text.year_month("t"), t=raw) == want


def test_quotes_and_lines(spark):
    assert one(spark, text.normalize_quotes("t"), t=",,Hé” ''x'' ‘y’ ``z``") == '"Hé" "x" \'y\' "z"'
    assert one(spark, text.normalize_text("t"), t=" a  \r\nb c\n\n\n\nd ") == "a\nb\nc\n\nd"
    assert one(spark, text.word_count("t"), t="") == 0 and one(spark, text.word_count("t"), t=None) == 0


def test_features(spark):
    f = text.text_features("t")
    df = spark.createDataFrame([('één "twee drie" — x - y “z”',), ("",), (None,)], "t string").select(*[v.alias(k) for k, v in f.items()])
    a, b, c = df.collect()
    assert (a.total_words, a.em_dash_count, a.quote_count, a.quote_word_count) == (6, 2, 2, 3)
    assert b.em_dashes_per_1k_words is None and c.total_words == 0


def test_quarters(spark):
    d = text.parse_date("t")
    assert one(spark, text.quarter_label(d), t="30/09/2020") == "2020-Q3"
    assert one(spark, text.quarter_number(d), t="30/09/2020") == 2020.5
    assert one(spark, text.quarter_period(d), t="31/12/2022") == "before_2023-Q1"
    assert one(spark, text.quarter_period(d), t="1/1/2023") == "2023-Q1_and_after"


# --- extraction and cleaning ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, want",
    [
        ("", []), (None, []), ("Door Jan Jansen", ["JAN JANSEN"]), ("jan jansen en piet de vries", ["JAN JANSEN", "PIET DE VRIES"]),
        ("MEREL VAN BEERS TOM TACKEN", ["MEREL VAN BEERS", "TOM TACKEN"]), ("Jan (foto) Jansen, Utrecht", ["JAN", "JANSEN"]), ("jesper @ed.nl", []),
        ("foto", []), ("PIET KAMPEN", ["PIET K"]), ("Jan Bos en jan bos", ["JAN BOS"]), ("12 Saskia Smit", ["SASKIA SMIT"]),
        ("Wafa Al / Ali", ["WAFA AL ALI"]),
    ],
)
def test_authors(spark, raw, want):
    assert one(spark, extract.clean_author("t"), t=raw) == want


def test_cleaning(spark):
    clean = lambda t: one(spark, extract.clean_base("t"), t=t)
    assert clean(None) == "" and clean("") == ""
    assert clean("Kop\n\nTussenkop\n\nEen zin met een punt.\n\nNog een.") == "Een zin met een punt.\n\nNog een."
    assert clean("AMSTERDAM - De trein rijdt.") == "De trein rijdt."
    assert clean("DEN HAAG (ANP): De minister zei het.") == "De minister zei het."
    assert clean("Een zin.\n\nBekijk de oorspronkelijke pagina: pagina 3\nrest") == "Een zin."
    assert clean("Een.\n\nkop een\n\nkop twee\n\nTwee.") == "Een.\n\nkop twee\n\nTwee."
    assert clean("Een zin.\n\nFictie\n\nTitel") == "Een zin."
    place = lambda t: one(spark, extract.strip_place(F.col("t")), t=t)
    assert place("Steenwijk - De raad") == "De raad" and place("steenwijk de raad") == "steenwijk de raad"
    both = spark.createDataFrame([("Een zin.\n\nJan B. (Bos)", ["JAN B. (BOS)"])], "t string, a array<string>")
    assert both.select(extract.clean_ed("t", "a").alias("x")).first().x == "Een zin."


def test_articles_from_a_dump(spark):
    dump = "1. toc\nTitel; krant\nde Telegraaf\n3 mei 2024 vrijdag\nSection: NIEUWS; p. 3\nByline: Door Jan Bos\nHighlight: Kort.\nBody\nEen zin met een punt.\nLoad-Date: x\nEnd of Document\nniets"
    df = extract.extract_fields(extract.split_dump(spark.createDataFrame([(dump,)], "value string")), "de Telegraaf")
    r = extract.clean_articles(df).first()
    assert (r.title, r.date, r.section, r.author, r.full_text, r.highlight) == ("Titel", "03/05/2024", "NIEUWS", ["JAN BOS"], "Een zin met een punt.", "Kort.")


# --- junk ----------------------------------------------------------------------------------------------------------

LONG = "woord " * 60


@pytest.mark.parametrize(
    "title, body, source, want",
    [
        ("t", LONG, "x", False), ("t", "w " * 49, "x", True), ("t", "w " * 50, "x", False), ("Sudoku", LONG, "x", True), ("t", LONG + "colofon", "x", True),
        ("Recept: taart", LONG, "x", True), ("t", "Ingrediënten " + LONG, "x", True), ("t", LONG + "snijd meng strooi", "x", True),
        ("t", LONG + "\n100 gram meel\n2 el suiker\n3 eetlepel olie", "x", True), ("t", LONG + " 11.00-17.00" * 4, "x", True), ("t", LONG + " 11.00-17.00" * 2, "x", False),
        ("t", LONG + " 11.00" * 5 + " entree excursie", "x", True), ("t", LONG + " 11.00" * 5 + " entree", "x", False),
        ("t", "\n".join(["- " + "w " * 10] * 4 + ["w " * 10] * 3), "x", True), ("t", "\n".join(["- " + "w " * 10] * 3 + ["w " * 10] * 3), "x", False),
        ("t", "Hoeveel verdien je " + LONG, "Eindhovens Dagblad", True), ("t", "de uitslagen van " + LONG, "Nieuwsblad Noordoost-Friesland", True),
        ("t", "3 jan. \n\n" + LONG, "Steenwijker Courant", True), ("t", LONG + " stand voetbal " + LONG, "Dagblad van het Noorden", True), ("t", LONG, "Dagblad van het Noorden", True),
    ],
)
def test_junk(spark, title, body, source, want):
    df = spark.createDataFrame([(title, body, source, [])], "title string, full_text string, source string, author array<string>")
    assert df.select(junk.is_junk().alias("x")).first().x is want
    assert junk.drop_junk(df).count() == (not want)


# --- topics --------------------------------------------------------------------------------------------------------


def test_topics(spark):
    parse = lambda t: one(spark, topics.parse_response("t"), t=t)
    assert parse("1") == "crime, law and justice" and parse("99") is None and parse("about Sport") == "sport" and parse("") is None
    p = one(spark, topics.prompt("t", limit=3), t="abcdef")
    assert "abc\nResult ID:" in p and "16: weather" in p
    assert "No content" in one(spark, topics.prompt("t"), t=None)
    gold = spark.sql("SELECT array(array(array('medtop:01','b'), array('x','c')), array(array('medtop:15','a'), array('medtop:01','b'))) AS c")
    assert gold.select(topics.gold_labels("c").alias("x")).first().x == ["a", "b"]
    tax = spark.sql("SELECT map('1 - Head\\tz', array('2 - Sub\\tq')) AS mapping")
    assert topics.taxonomy(tax).collect() == [("Head", "Sub")]
    votes = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "B"), (2, 0, "Z"), (2, 1, "Y"), (2, 1, "Y")], "k int, i int, l string")
    assert {(r.k, r.head_topic) for r in topics.reciprocal_rank_vote(votes, "k", "i", "l").collect()} == {(1, "A"), (2, "Z")}


def test_balance(spark):
    rows = [("s", "kept", f"{d}/1/2020") for d in range(1, 16)] + [("s", "kept", f"{d}/3/2020") for d in range(1, 16)]
    rows += [("s", "rare", f"{d}/1/2020") for d in range(1, 15)] + [("s", " ", "1/1/2020"), ("s", "kept", "31/02/2020")]
    df = spark.createDataFrame(rows, "source string, predicted_topic string, date string")
    assert topics.balance_topics(df).groupBy("predicted_topic").count().collect() == [("kept", 30)]
    assert {(r.predicted_topic, r.months_present, r.kept) for r in topics.topic_summary(df).collect()} == {("kept", 2, "yes"), ("rare", 1, "no")}


# --- statistics ----------------------------------------------------------------------------------------------------


def test_special_functions():
    assert math.isclose(stats.chi2_1_sf(3.841458820694124), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.t_sf2(2.2281388519649385, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.t_sf2(12.706204736432095, 1), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.chi2_sf(7.814727903251179, 3), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.incomplete_beta(2, 3, 0.5), 0.6875, rel_tol=1e-10)


def test_closed_forms(spark):
    lit = F.lit
    assert math.isclose(one(spark, stats.chi2_2x2(lit(10), lit(20), lit(100), lit(100)), t="x"), 200 * (10 * 80 - 20 * 90) ** 2 / (30 * 170 * 100 * 100))
    assert one(spark, stats.chi2_2x2(lit(0), lit(0), lit(5), lit(5)), t="x") == 0
    assert one(spark, stats.chi2_2x2(lit(10), lit(20), lit(100), lit(100), True), t="x") < 3.9
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r.i: r.p_adj for r in stats.benjamini_hochberg(df, "p").collect()}
    assert got[4] is None and np.allclose([got[1], got[2], got[3]], [0.03, 0.04, 0.04])


def test_bh_properties(spark):
    r = np.random.default_rng(0)
    p = [0.0, 1.0, *r.uniform(size=60).round(2).tolist()]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(p)], "g int, p double")
    for g, part in stats.benjamini_hochberg(df, "p", ["g"]).toPandas().groupby("g"):
        part = part.sort_values("p")
        assert (part.p_adj >= part.p - 1e-12).all() and (part.p_adj.diff().dropna() >= -1e-12).all()


def test_bh_large(spark):
    r = np.random.default_rng(1)
    rows = [(None if v < 0.2 else int(v * 3), None if v > 0.9 else v) for v in r.uniform(size=300).round(2).tolist()]
    df = spark.createDataFrame(rows, "g int, p double")
    small, large = (stats.benjamini_hochberg(df, "p", ["g"], large=x) for x in (False, True))
    assert small.columns == large.columns and sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    # a frame that ends with the group is gone through anew for each row
    assert all("unboundedfollowing$()" not in line or "unboundedpreceding$()" in line for x in (small, large) for line in windows(x))
    # p_i = i / n: every adjusted value is the largest
    n = 60_000
    one_group = spark.range(1, n + 1).select(F.lit("a").alias("g"), (F.col("id") / n).alias("p"))
    for x in (False, True):
        got = stats.benjamini_hochberg(one_group, "p", ["g"], large=x).agg(F.count("p_adj").alias("n"), F.min("p_adj").alias("a"), F.max("p_adj").alias("b")).first()
        assert got.n == n and math.isclose(got.a, 1) and got.b == 1


def windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [f for line in plan.splitlines() for f in line.split("specifiedwindowframe")[1:]]


def test_mann_whitney(spark):
    df = spark.createDataFrame([("a", True, 3.0), ("a", True, 4.0), ("a", False, 1.0), ("a", False, 2.0), ("b", True, 1.0)], "g string, s boolean, v double")
    got = {r.g: r for r in stats.mann_whitney(df, ["g"], "s", "v").collect()}
    assert got["a"].u == 4 and 0 < got["a"].p_value < 1 and got["b"].u is None and got["b"].p_value is None


# --- AI use --------------------------------------------------------------------------------------------------------


def ai_rows(spark):
    w = lambda *s: [("x", v, "high") for v in s]
    rows = [
        ("d", "1/1/2023", ["A", "B"], "Opinie", "sport", "de Volkskrant", 'x "y z" — w', 1.0, 0.0, w(0.5, None)),
        ("d", "31/12/2022", None, "", None, "telegraaf", "", 0.0, 0.3, w()), ("e", "2/2/2024", [], "WATUZEGT ", "sport", "De Telegraaf", "a b", 0.0, 0.0, None),
        ("e", "bad", ["C"], "s", "t", "x", "a", 0.1, 0.0, None), ("e", "1/1/2024", ["C"], "s", "t", "x", "a", None, 0.0, None),
    ]
    return spark.createDataFrame(rows, f"dataset string, date string, author array<string>, section string, predicted_topic string, source string, full_text string, fraction_ai double, fraction_ai_assisted double, windows array<{schemas.WINDOW}>")


def test_ai_use(spark):
    df = ai_use.build_frame(ai_rows(spark))
    assert df.count() == 3
    assert ai_use.guard_counts(ai_rows(spark)).first().asDict() == {"rows": 5, "no_score": 1, "bad_date": 1}
    a = df.where("quarter = '2023-Q1'").first()
    assert a.is_ai_strict and a.is_ai_broad and a.mean_ai_assistance_score == 0.5 and a.period == "2023-Q1_and_after"
    b = df.where("quarter = '2022-Q4'").first()
    assert not b.is_ai_strict and b.is_ai_broad and b.section == "Geen Sectie" and b.predicted_topic == "Geen Topic" and b.quote_word_fraction is None
    total = {(r.dataset, r.definition): (r.total_articles, r.ai_articles) for r in ai_use.summarize_with_total(df, "dataset", []).collect()}
    assert total[("ALL newspapers", "broad")] == (3, 2) and total[("d", "strict")] == (2, 1)
    assert sorted(r.author for r in ai_use.explode_authors(df).collect()) == ["A", "B", "NO AUTHOR", "NO AUTHOR"]
    got = {(r.newspaper, r.section_group, r.definition): r.total_articles for r in ai_use.opinion_vs_rest(df).collect()}
    assert got == {("de Volkskrant", "opinion", "strict"): 1, ("de Volkskrant", "opinion", "broad"): 1, ("de Telegraaf", "opinion", "strict"): 1, ("de Telegraaf", "opinion", "broad"): 1}
    shares = ai_use.topic_shares(df, "dataset", "predicted_topic").groupBy("dataset", "definition").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)
    assert ai_use.recent(df).count() == 1
    assert ai_use.rank_tests(df, ["dataset"], "is_ai_strict").count() > 0
    assert ai_use.describe_by_flag(df, ["is_ai_broad"]).count() == 2
    assert ai_use.summarize(df, ["section"], "mean_ai_assistance_score").where("section = 'Opinie'").first().mean_ai_assistance_score == 0.5
    joined, fan = ai_use.attach_detector(df.select("dataset"), spark.createDataFrame([("d", 1), ("d", 2)], "dataset string, z int"), ["dataset"])
    assert joined.count() == 5 and fan.first().matches == 2
    assert ai_use.pending(df, df.where("dataset = 'd'"), ["dataset"]).count() == 1


# --- metrics -------------------------------------------------------------------------------------------------------


def tok(i, lemma, upos, head, deprel="dep", feats=None):
    return (i, lemma, lemma, upos, feats, deprel, head)


def parses(spark):
    s1 = [tok(1, "de", "DET", 2), tok(2, "hond", "NOUN", 3), tok(3, "lopen", "VERB", 0, "root", "VerbForm=Fin"), tok(4, "waarheid", "NOUN", 3)]
    s2 = [tok(1, "grondig", "ADV", 2), tok(2, "zien", "VERB", 0, "root"), tok(3, "en", "CCONJ", 4), tok(4, "slapen", "VERB", 2, "conj"), tok(5, ".", "PUNCT", 2), tok(6, None, "X", 9)]
    cycle = [tok(1, "a", "NOUN", 2), tok(2, "b", "NOUN", 1)]
    return spark.createDataFrame([(1, [s1, s2]), (2, None), (3, []), (4, [cycle])], f"article_id int, parsed_sentences {metrics.PARSE}")


def test_metrics(spark):
    got = {r.article_id: r for r in metrics.article_metrics(parses(spark)).collect()}
    a = got[1]
    assert (a.total_words, a.total_sentences, a.mtld) == (10, 2, None)
    assert a.freq_det == 100 and a.freq_cconj == 100 and a.care_rigour_freq_per1k == 100 and a.importance_freq_per1k == 0
    assert a.mean_sent_len == 5 and math.isclose(a.cv_sent_len, math.sqrt(2) / 5)
    assert a.mean_dep_depth == (2 + 2) / 2 and a.finite_verbs_per_sent == 1 and a.mean_tunit_len == (4 + 3) / 2 and a.nom_rate == 0.5
    assert got[2].total_words == 0 and got[3].mean_sent_len is None and got[2].freq_det is None and got[4].cv_sent_len is None
    assert got[4].mean_dep_depth == 2


def test_mtld():
    assert metrics.mtld_of([]) is None
    assert metrics.mtld_of(["a"] * 10) == 2.0
    assert metrics.mtld_of([str(i) for i in range(60)]) is None
    mixed = ["a", "b", "c", "a", "b", "c"] * 10
    assert 3 < metrics.mtld_of(mixed) < 6


def test_lexicon(spark):
    raw = spark.createDataFrame([("hond N(soort)", "10"), ("x", "5"), ("kat Q(x)", "z"), ("lopen WW(x)", "30"), ("", None)], "_c0 string, _c1 string")
    lex = files.frequency_list(raw)
    assert {(r.lemma, r.upos, r.frequency) for r in lex.collect()} == {("hond", "NOUN", 10), ("lopen", "VERB", 30)}
    twice = spark.createDataFrame([("a", 1, 0), ("a", 10, 1), ("b", 0, 2)], "lemma string, frequency long, o int")
    z = {r.lemma: r.zipf for r in metrics.zipf_lexicon(twice, order="o", corpus_size=1_000_000).collect()}
    assert math.isclose(z["a"], 4.0) and z["b"] == 1.0
    lemmas = spark.createDataFrame([(1, ["a", "a", "b", "q"])], "k int, l array<string>")
    r = metrics.lexical_sophistication(lemmas, "k", "l", metrics.zipf_lexicon(twice, order="o", corpus_size=1_000_000)).first()
    assert (r.prop_low_freq, r.prop_high_freq) == (0.5, 0.5) and math.isclose(r.mean_zipf, 3.0)


def test_large_lexicon(spark):
    texts = spark.createDataFrame([(1, "a a b q c d"), (2, "d e"), (3, "q"), (None, "a a b"), (4, None), (5, "a b c")], "k int, t string")
    lemmas = texts.select("k", F.split("t", " ").alias("l"))
    lemmas = lemmas.unionAll(spark.createDataFrame([(6, ["a", None])], "k int, l array<string>"))
    z = {"a": 6.0, "b": 5.0, "c": 4.0, "d": 2.5, "e": 2.0}
    want = {}
    for r in lemmas.collect():
        if r.l:
            v, known = [z.get(w, 1.0) for w in r.l], [z[w] for w in r.l if w in z]
            want[r.k] = (sum(x < 3 for x in v) / len(v), sum(x >= 4 for x in v) / len(v), sum(known) / len(known) if known else None)
    lexicon = spark.createDataFrame(list(z.items()), "lemma string, zipf double")
    for rows in (1, 2, 4, 5, 500):
        out = metrics.lexical_sophistication(lemmas, "k", "l", lexicon, broadcast_rows=rows)
        got = {r.k: (r.prop_low_freq, r.prop_high_freq, r.mean_zipf) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all((a is None and b is None) or math.isclose(a, b) for k in want for a, b in zip(got[k], want[k]))
        # the common words of a larger lexicon are broadcast, and texts are cut once
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1 and ("strategy=broadcast" in plan)


def test_lexicon_reads_texts_once(spark):
    counts = spark.createDataFrame([("a b a",)], "t string").select(F.explode(F.split("t", " ")).alias("lemma")).groupBy("lemma").agg(F.count("*").alias("frequency"))
    lexicon = metrics.zipf_lexicon(counts, order="lemma")
    assert {r.lemma: round(r.zipf, 9) for r in lexicon.collect()} == {"a": round(3 + math.log10(2e6 / 3), 9), "b": round(3 + math.log10(1e6 / 3), 9)}
    assert "Generate explode" not in lexicon._jdf.queryExecution().optimizedPlan().toString()


# --- shift ---------------------------------------------------------------------------------------------------------


def test_shift(spark):
    d = lambda t: one(spark, shift.period_of(F.col("t").cast("date")), t=t)
    assert [d(t) for t in ("2022-11-30", "2022-12-01", "2023-06-01", "2024-01-01", "2025-12-31", "2020-12-31")] == ["pre", None, None, "post", "post", None]
    words = [(f"k{i}_NOUN", f"k{i}", "NOUN", float(100 - i), (-1) ** i * 0.05 * (i + 1), 10, 10) for i in range(12)] + [("low_NOUN", "low", "NOUN", 500.0, 9.0, 9, 10), ("p_PUNCT", "p", "PUNCT", 500.0, 9.0, 90, 10)]
    w = spark.createDataFrame(words, schemas.SCORED_WORDS)
    ai = shift.ai_words(w, 2).collect()
    assert {(r.method, r.rank, r.key) for r in ai} == {("G2", 1, "k0_NOUN"), ("G2", 2, "k2_NOUN"), ("LPR", 1, "k10_NOUN"), ("LPR", 2, "k8_NOUN")}
    assert [r.key for r in shift.baseline_words(w, 2).collect()] == ["k1_NOUN"]
    with pytest.raises(ValueError):
        shift.assert_columns(w, ["nope"])
    parsed = parses(spark).withColumns({"source": F.lit("de Telegraaf"), "period": F.when(F.col("article_id") == 1, "pre").otherwise("post")})
    counts, totals = shift.token_counts(parsed, None)
    assert totals.where("period = 'pre'").first().total == 8
    keys = spark.createDataFrame([("hond_NOUN", "AI", 1), ("zzz_NOUN", "AI", 2)], "key string, method string, rank int")
    st = {r.key: r for r in shift.word_stats(keys, counts, totals, ["source"]).collect()}
    assert st["hond_NOUN"].pre == 1 and st["hond_NOUN"].pct_change == -100 and st["zzz_NOUN"].pct_change is None and st["zzz_NOUN"].chi2 == 0
    summary = shift.with_tests(shift.set_summary(shift.word_stats(keys, counts, totals, ["source"]), ["source"], ["method"], [1, 2]), ["source"])
    assert summary.count() == 2 and summary.where("p_adj < p_value").count() == 0
    grouped = counts.withColumn("group", F.lit("national"))
    kinds = {r.scope_kind for r in shift.roll_up(grouped, "n", ["period", "key"]).collect()}
    assert kinds == {"overall", "group", "paper"}
    focal = shift.focal_rates(parses(spark), "article_id", spark.createDataFrame([("hond_NOUN", 2.0)], "key string, LPR double")).where("article_id = 1").first()
    assert focal.focal_count == 1
    k = shift.keyness(spark.createDataFrame([("a", 5, 5), ("b", 5, 5)], "key string, c_h long, c_m long")).first()
    assert abs(k.g2) < 1e-9 and abs(k.lpr) < 1e-9


# --- panels --------------------------------------------------------------------------------------------------------


def test_panels(spark):
    df = spark.createDataFrame([("a", "2019-12-05", 1.0, "x"), ("a", "2020-02-01", 3.0, "x"), ("a", "2020-03-01", 5.0, "y"), ("b", "2022-12-01", 7.0, None)], "outlet string, d string, v double, topic string").withColumn("d", F.col("d").cast("date"))
    its = {str(r.d): (r.time, r.intervention, r.time_after) for r in panel.its_variables(df, "d").collect()}
    assert its["2020-02-01"][0] == its["2020-03-01"][0] == 2 and its["2022-12-01"][1:] == (1, 0)
    exact = {str(r.d): r.time for r in panel.its_variables(df, "d", exact_months=True).collect()}
    assert exact["2020-03-01"] == 3
    t = panel.timeline(df, ["outlet"], "d", "month", ["v"]).where("outlet = 'a'").orderBy("period").collect()
    assert [r.n_articles for r in t] == [1, 0, 1, 1] and t[1].v is None
    e = panel.topic_entropy(df, ["outlet"], "topic").collect()
    assert len(e) == 1 and math.isclose(e[0].topic_entropy, -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)), rel_tol=1e-6)
    assert panel.within_sd(df, ["v"], ["outlet"]).where("outlet = 'b'").first().sd_v is None
    z = {r.v: r.composite for r in panel.composite(df, ["v"], "outlet", {"v": -1}).collect()}
    assert math.isclose(z[1.0], 1.0) and z[7.0] is None
    j = panel.journalists(df.withColumn("author", F.when(F.col("v") > 2, "Jan; Piet")), "author").collect()
    assert {r.journalist_id for r in j} == {"a::NA", "a::Jan", "b::Jan"}
    assert panel.metric_columns(["mtld", "x", "baseline_word_20", "a_freq_per1k"]) == ["mtld", "baseline_word_20", "a_freq_per1k"]
    assert panel.direction("baseline_word_20") == 0 and panel.direction("new") == 1 and panel.direction("mtld") == -1
    assert panel.outlets(spark).count() == 6 and panel.metric_label("freq_det") == "Det"
    assert {r.column: r.coverage_pct for r in panel.quality_report(df, ["v", "topic"]).collect()} == {"v": 100.0, "topic": 75.0}
    assert panel.concentration(spark.createDataFrame([(float(i),) for i in range(1, 21)], "slope double")).first().label == "broad"
    assert panel.flagged_audit(df, df.where("v = 1"), ["outlet", "d"]).count() == 1


# --- inference -----------------------------------------------------------------------------------------------------


def test_ols_and_newey_west(spark):
    r = np.random.default_rng(1)
    n = 60
    rows = []
    for o in ("a", "b"):
        for t in range(n):
            post = int(t >= 30)
            rows.append((o, t, post, max(0, t - 30), 500.0 + t % 7, 2 + 0.1 * t - 1.5 * post * (o == "a") + r.normal(0, 0.01)))
    df = spark.createDataFrame(rows, "outlet string, time int, intervention int, time_after int, mean_words double, m double")
    got = {(x.outlet, x.term): x for x in inference.its(df, ["m"], ["outlet"]).collect()}
    assert abs(got[("a", "intervention")].estimate + 1.5) < 0.05 and got[("a", "intervention")].p_adj < 0.01
    assert abs(got[("b", "time")].estimate - 0.1) < 0.01 and got[("a", "time")].n_obs == n
    assert inference.its(df.where("time < 15"), ["m"], ["outlet"]).count() == 0
    x = np.column_stack([np.ones(50), np.arange(50.0)])
    y = 1 + 2 * x[:, 1] + r.normal(size=50)
    beta, e, inv = inference.ols(x, y)
    v0 = inference.newey_west(x, e, inv, lag=0)
    g = x * e[:, None]
    assert np.allclose(v0, inv @ (g.T @ g) @ inv * 50 / 48)
    assert inference.newey_west(x, e, inv, prewhite=True).shape == (2, 2)
    lm = inference.linear_model(spark.createDataFrame(pd.DataFrame({"y": y, "x": x[:, 1]})), "y", ["x"])
    assert np.allclose(lm.estimate, beta, atol=1e-6)


def test_split_tests(spark):
    rows = [(o, p, float(i % 5 + (p == "post"))) for o in "ab" for p in ("pre", "post") for i in range(20)]
    df = spark.createDataFrame(rows, "outlet string, period string, mtld double")
    out = inference.split_ttest(df, ["mtld"], "period", ["outlet"]).collect()
    assert len(out) == 3 and all(r.t > 0 and r.p_value < 0.05 and not r.direction_match for r in out)
    assert inference.split_ttest(df, ["mtld"], "period", minimum=100).count() == 0
    f = df.withColumn("id", F.monotonically_increasing_id())
    assert inference.compare_flagged(f, f.where("period = 'post'"), ["id"], ["mtld"]).count() == 1
    stat, p = inference.fligner([np.arange(20.0), np.arange(20.0) * 5])
    assert p < 0.01 and inference.wilcoxon_less(np.arange(10.0) + 5, np.arange(10.0)) < 0.05 < inference.wilcoxon_less(np.arange(10.0), np.arange(10.0) + 5)
    s = spark.createDataFrame([("m", p, float(i) * (2 if p == "pre" else 1)) for p in ("pre", "post") for i in range(8)], "metric string, period string, v double")
    assert inference.homogenization_tests(s, "v", "period", ["metric"]).first().direction == "homogenizing"


def test_mixed_model_recovers_simulation(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(60):
        a, b = r.normal(0, 1), r.normal(0, 0.3)
        for t in np.linspace(0, 5, 12):
            rows.append((g, float(t), float(2 + a + (0.7 + b) * t + r.normal(0, 0.5))))
    df = spark.createDataFrame(rows, "g int, t double, y double")
    fixed, rand = inference.mixed_model(df, "y", ["t"], "g", ["t"])
    assert abs(fixed.estimate[1] - 0.7) < 0.15 and abs(fixed.estimate[0] - 2) < 0.5
    assert 0.2 < rand["t"].std() < 0.45 and len(rand) == 60
    assert inference.mixed_model(df.limit(10), "y", ["t"], "g")[0].empty


def panel_rows(spark, effect=1.0):
    """Journalists in outlets of three types over 30 months, with a jump at month 15 that is larger in local outlets."""
    r = np.random.default_rng(6)
    rows = []
    kinds = {"n1": "national", "n2": "national", "r1": "regional", "l1": "local", "l2": "local"}
    for o, kind in kinds.items():
        top = r.normal(0, 1.0)
        for j in range(8):
            a, b = r.normal(0, 0.5), r.normal(0, 0.02)
            for t in range(30):
                post = int(t >= 15)
                y = 5 + top + a + (0.05 + b) * t + post * (effect + 2 * (kind == "local")) + r.normal(0, 0.3)
                rows.append((o, kind, f"{o}::{j}", t, post, max(0, t - 15), 100 + t % 5, "ab"[t % 2], (pd.Timestamp(2021, 1, 1) + pd.DateOffset(months=t)).date(), float(y), float(y + r.normal())))
    schema = "outlet string, outlet_type string, journalist_id string, time int, intervention int, time_after int, total_words int, predicted_topic string, year_month date, mtld double, score double"
    return spark.createDataFrame(rows, schema)


def test_two_level_models(spark):
    df = panel_rows(spark)
    terms = ["time", "intervention", "time_after", "total_words"]
    fixed, rand = inference.mixed_model(df, "mtld", terms, "journalist_id", ["time"], "outlet")
    est = fixed.set_index("term")
    assert abs(est.estimate["intervention"] - 1.8) < 0.3 and est.std_error["(Intercept)"] > 0.3 and len(rand) == 40
    flat = inference.mixed_model(df, "mtld", terms, "journalist_id", ["time"])[0].set_index("term")
    assert flat.std_error["(Intercept)"] < est.std_error["(Intercept)"]
    far, far_rand = inference.mixed_model(df, "mtld", terms, "journalist_id", ["time"], "outlet", steps=5, driver_groups=0)
    near, near_rand = inference.mixed_model(df, "mtld", terms, "journalist_id", ["time"], "outlet", steps=5)
    assert np.allclose(far.estimate, near.estimate) and np.allclose(far.std_error, near.std_error)
    both = far_rand.toPandas().set_index("journalist_id").join(near_rand.set_index("journalist_id"), rsuffix="_near")
    assert np.allclose(both["time"], both["time_near"])
    with_topic = inference.mixed_model(df, "mtld", terms, "journalist_id", ["time"], "outlet", ["predicted_topic", "outlet_type"])[0]
    assert {"predicted_topic=b", "outlet_type=national", "outlet_type=regional"} <= set(with_topic.term)


def test_model_wrappers(spark):
    df = panel_rows(spark)
    table, random = inference.journalist_its(df, ["mtld", "score"], steps=30)
    got = {(r.metric, r.term): r for r in table.collect()}
    assert set(got) == {(m, t) for m in ("mtld", "score") for t in inference.ITS_TERMS} and set(random) == {"mtld", "score"}
    jump = got[("mtld", "intervention")]
    assert jump.p_adj < 0.01 and jump.expected_direction == -1 and jump.direction_match is False and jump.significant and not jump.significant_correct_direction
    assert got[("score", "intervention")].significant_correct_direction  # unknown metrics are expected to rise
    assert inference.journalist_its(df, ["mtld"], minimum=10_000)[0].count() == 0
    types = {r.term: r for r in inference.outlet_type_its(df, ["mtld"], steps=30).collect()}
    local = types["intervention:outlet_typelocal"]
    assert abs(local.estimate - 2) < 0.4 and local.conf_low < 2 < local.conf_high and abs(types["intervention:outlet_typeregional"].estimate) < 0.4
    from loomtext.operators import figures

    assert {r.term_clean for r in figures.forest(spark.createDataFrame([tuple(r) for r in types.values()], inference.outlet_type_its(df, ["mtld"], steps=2).schema)).collect()} >= {"local", "intervention × local"}
    topics_ = inference.topic_its(df, ["mtld"], minimum=10)
    assert {r.predicted_topic for r in topics_.select("predicted_topic").collect()} == {"a", "b"}
    series, check = inference.detector_analysis(df, "score", ["mtld"])
    assert series.where("term = 'intervention'").count() == 5 and abs(check.set_index("term").estimate["mtld"] - 1) < 0.2
    assert inference.detector_analysis(df, "score", ["mtld"], minimum=10**6)[1].empty
    parts = inference.homogenization(df, ["mtld"], topic="predicted_topic")
    assert set(parts) == {"within_outlet", "its_outlet", "within_topic", "its_topic", "between", "tests"}
    assert parts["its_outlet"].where("term = 'time'").count() == 5 and parts["between"].count() == 30 and parts["tests"].first().metric == "mtld"
    slopes = spark.createDataFrame(random["mtld"])
    assert figures.sorted_slopes(slopes, "time").count() == 40 and figures.slope_histogram(slopes, "time").agg(F.sum("n")).first()[0] == 40
    assert figures.trajectories(df, "mtld", most=3).select("journalist_id").distinct().count() == 3


def test_medians_by_flag(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": r.integers(0, 3, 400), "a": r.integers(0, 9, 400).astype(float), "b": r.normal(size=400)})
    pdf.loc[pdf.index % 7 == 0, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    for x in ai_use.describe_by_flag(df, ["g"], ["a", "b"]).collect():
        own = pdf[pdf.g == x.g]
        assert (x.n_a, x.n_b) == (own.a.count(), own.b.count())
        assert np.allclose([x.mean_a, x.mean_b, x.median_a, x.median_b], [own.a.mean(), own.b.mean(), own.a.median(), own.b.median()])


def test_sub_topics(spark):
    heads = spark.createDataFrame([("H", "a"), ("I", "b")], "head_topic string, sub_topic string")
    df = spark.createDataFrame([(1, "['a']"), (2, "nope"), (3, None)], "id int, s string")
    got = {r.id: (r.predicted_head_topic, r.error) for r in topics.subtopics_to_heads(df, heads, "id", "s").collect()}
    assert got[1] == ("H", None) and got[2] == (None, "not a list of sub-topics") == got[3]


def test_negative_binomial():
    r = np.random.default_rng(5)
    x = r.normal(size=800)
    mu = np.exp(1 + 0.5 * x)
    y = r.negative_binomial(5, 5 / (5 + mu))
    out = inference.negative_binomial(pd.DataFrame({"y": y, "x": x, "n": np.ones(800)}), "y", ["x"], "n")
    assert abs(out.estimate[1] - 0.5) < 0.12 and 2 < out.theta[0] < 12


# --- sampling, sources, back ends, stream --------------------------------------------------------------------------


def test_sampling(spark):
    df = spark.range(1, 101)
    got = sorted(r.id for r in sampling.systematic_sample(df, 10, "id", 3.5).collect())
    assert got == [int(3.5 + i * 10) for i in range(10)]
    with pytest.raises(ValueError):
        sampling.systematic_sample(df, 101, "id")
    assert sampling.hash_sample(df, 5, "id").collect() == sampling.hash_sample(df.repartition(7), 5, "id").collect()
    s = sampling.stratified_split(df.withColumn("g", F.col("id") % 4), "g", "id").groupBy("g", "split").count().collect()
    assert {r["count"] for r in s if r.split == "dev"} == {10}
    assert sampling.cap_groups(df.withColumn("g", F.col("id") % 20), "g", 5).select("g").distinct().count() == 5


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_systematic_sample_of_wide_rows(spark, adaptive):
    """All rows come back, the same ones each time, whatever the plan makes of wide columns, ties and nulls."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(0, 200_000, 1, 9).select((F.col("id") * 7 % 200_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 16).alias("pad"))
        want = sorted(int(1 + i * 2000) - 1 for i in range(100))
        for _ in range(2):
            out = sampling.systematic_sample(wide, 100, "k")
            assert out.columns == wide.columns and sorted(r.k for r in out.select("k").collect()) == want
        ties = spark.createDataFrame([(None, "x")] * 3 + [(1, "a")] * 5 + [(2, c) for c in "cd"], "k int, v string")
        got = sorted(map(str, (tuple(r) for r in sampling.systematic_sample(ties, 10, "k").collect())))
        assert got == sorted(map(str, (tuple(r) for r in ties.collect())))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_split_of_uneven_strata(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a" if i % 3 == 1 else f"one{i}") for i in range(300)], "id int, s string")
    got = sampling.stratified_split(df, "s", "id", 0.25).groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "dev").alias("dev")).collect()
    assert all(r.dev == math.floor(r.n * 0.25 + 0.5) for r in got) and sum(r.n for r in got) == 300


def docx(paragraphs, cells=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>" if cells else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx(["één", "", "twee"], ["cel"]))
    (tmp_path / "in" / "b.DOCX").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_docx(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.docx": "één\n\ntwee\n\ncel", "b.DOCX": None}
    files.write_texts(files.read_docx(spark, str(tmp_path / "in")), str(tmp_path / "txt"))
    assert files.read_dump(spark, str(tmp_path / "txt")).count() >= 1
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text(json.dumps([{"title": "é"}, {"title": "b"}]))
    (tmp_path / "j" / "y.jsonl").write_text('{"title": "c"}\nbroken{\n')
    rows = files.read_folder(spark, str(tmp_path / "j"), schemas.ARTICLE).collect()
    assert sorted((r.title, r.dataset) for r in rows if r.title) == [("b", "x"), ("c", "y"), ("é", "x")]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "j" / "y.jsonl"), schemas.ARTICLE, strict=True).collect()
    gold = tmp_path / "g" / "id1"
    gold.mkdir(parents=True)
    (gold / "dnaf.json").write_text(json.dumps({"doc": {"token_string": "t", "annotations": {"iptc_codes": {"certain": [[["medtop:01", "a"]]]}}}}))
    assert files.read_gold_tree(spark, str(tmp_path / "g")).first().id == "id1"
    (tmp_path / "t.csv").write_bytes(("wort;n\n" + "\n".join(f"é{i};{i}" for i in range(120)) + "\nshort\n").encode("latin-1"))
    t = files.read_delimited(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["wort", "n"] and t.count() >= 120
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(tmp_path / "t.csv"), 1000)
    (tmp_path / "q.txt").write_text('"Word"\t"n"\n' + "\n".join(f"\"w{i}\"\t'{i}'\textra" for i in range(5)) + "\nshort\n\n")
    q = files.read_delimited(spark, str(tmp_path / "q.txt"), 5)
    assert q.columns == ["Word", "n"] and sorted(map(tuple, q.collect())) == [(f"w{i}", str(i)) for i in range(5)]
    (tmp_path / "d.jsonl").write_text('{"title": "t", "windows": [{"ai_assistance_score": 0.5}, {"label": "x"}]}\n{"title": "u", "error": "no"}\n')
    assert {r.title: r.mean_ai_assistance_score for r in files.read_detector(spark, str(tmp_path / "d.jsonl")).collect()} == {"t": 0.5, "u": None}
    (tmp_path / "o.csv").write_text("a,b\n1,2\n")
    o = files.read_outlets(spark, {"vk": str(tmp_path / "o.csv"), "ed": str(tmp_path / "none.csv")}, {"vk": "national"})
    assert o.first().outlet_type == "national"
    with pytest.raises(FileNotFoundError):
        files.read_outlets(spark, {"ed": str(tmp_path / "none.csv")}, {})
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, period string")
    files.write_per_value(df, str(tmp_path / "pv"), "period")
    assert files.read_csv(spark, str(tmp_path / "pv" / "all")).count() == 2
    assert files.append_new(df, str(tmp_path / "log"), ["k"]) == 2 and files.append_new(df.unionAll(df.selectExpr("k + 1", "period")), str(tmp_path / "log"), ["k"]) == 1
    assert one(spark, files.parse_label_list("t"), t="['a', 'b']") == ["a", "b"] and one(spark, files.parse_label_list("t"), t="oops") is None


def test_backends(spark):
    df = spark.createDataFrame([("sport athletes tournaments", "x"), ("", "y"), (None, "z")], "full_text string, title string")
    out = {r.title: r.predicted_topic for r in backends.classify(df).collect()}
    assert out["x"] == "sport"

    class Failing:
        def detect(self, t):
            raise RuntimeError("no")

    assert backends.detect(df, make=Failing).first().error == "no"
    r = backends.detect(df).first()
    assert r.fraction_human is not None and r.error is None and backends.detect(df).count() == 1
    a = {r.title: r.parsed_sentences for r in backends.annotate(df.withColumn("full_text", F.concat("full_text", F.lit(". De hond is lief."))), "full_text").collect()}
    assert len(a["x"]) == 2 and a["z"] is None and a["x"][1][2].upos == "AUX"
    m = metrics.article_metrics(backends.annotate(df.withColumn("article_id", F.monotonically_increasing_id()), "full_text"))
    assert m.count() == 3


def test_landing_stream_forgets(spark, tmp_path):
    """With a watermark keys are remembered for its delay only."""
    src = tmp_path / "land"
    src.mkdir()
    read = landing.read_landing(spark, str(src), "k int, t timestamp", ["k"], ("t", "1 hour"))
    (src / "1.json").write_text('{"k": 1, "t": "2024-01-01T00:00:00Z"}\n{"k": 1, "t": "2024-01-01T00:10:00Z"}\n')
    for n, more in ((2, '{"k": 2, "t": "2024-01-02T00:00:00Z"}\n'), (3, '{"k": 1, "t": "2024-01-02T00:30:00Z"}\n')):
        landing.run_landing(read, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
        (src / f"{n}.json").write_text(more)
    landing.run_landing(read, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == [1, 1, 2]


def test_landing_stream(spark, tmp_path):
    src = tmp_path / "land"
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\n{"k": 2, "v": "c"}\n')
    run = lambda: landing.run_landing(landing.read_landing(spark, str(src), "k int, v string", ["k"], None), str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text('{"k": 2, "v": "d"}\n{"k": 3, "v": "e"}\n')
    run()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == [1, 2, 3]
