"""Registered queries whose answers are written down: every document runs through one of an operator's cases (by its id),
and the SQL twin lists the answers that were worked out by hand.  For operators that SQL can't express (look-around,
models) and for those whose edge cases the driver's tables don't hold."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import ai_use, backends, extract, figures, junk, metrics, panel, shift, topics
from ..sources import files, schemas

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def cased(spark: SparkSession, sf_dir: str, schema: str, inputs: list[tuple]) -> DataFrame:
    """doc_id, the case's number, and the case's inputs for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.pmod("doc_id", F.lit(len(inputs))).cast("int").alias("case"))
    return docs.join(F.broadcast(spark.createDataFrame([(k, *x) for k, x in enumerate(inputs)], f"case int, {schema}")), "case")


def golden(name: str, schema: str, cases: list[tuple[tuple, tuple | list[tuple]]], columns: dict[str, str], apply: Callable[[DataFrame], DataFrame]) -> None:
    """Register ``apply`` over inputs of ``schema``; ``cases``: (inputs, answer), where an answer is one row or a list of
    rows of ``columns`` (name to SQL type)."""
    inputs = [i for i, _ in cases]
    answers = [(k, *row) for k, (_, a) in enumerate(cases) for row in (a if isinstance(a, list) else [a])]
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in answers)
    shown = ", ".join(f"{c}::{kind} AS {c}" for c, kind in columns.items())
    Q[name] = lambda spark, sf_dir: apply(cased(spark, sf_dir, schema, inputs)).select("doc_id", *columns)
    SQL[name] = f'SELECT doc_id, {shown} FROM documents JOIN (VALUES {values}) AS v("case", {", ".join(columns)}) ON doc_id % {len(cases)} = "case"'


def column(name: str, schema: str, cases: list[tuple[tuple, object]], expr, kind: str = "VARCHAR") -> None:
    """golden() for a single column expression, the answer being ``out``."""
    golden(name, schema, [(i, (a,)) for i, a in cases], {"out": kind}, lambda df: df.withColumn("out", expr()))


def joined(c):
    return F.array_join(c, "|")


# --- text and extraction -------------------------------------------------------------------------------------------

column("normalized_text", "t string", [((" a  \r\nb c\n\n\n\nd ",), "a\nb\nc\n\nd"), (("x\ry",), "x\ny"), (("",), "")], lambda: text.normalize_text("t"))
column(
    "scoped_text", "title string, highlight string, full_text string, scope string",
    [(("T ", " ", "B", "all"), "T B"), (("T", "H", "B", "title_only"), "T"), (("T", "H", "B", "highlight_only"), "H"), (("T", None, " B", "body_only"), "B"), (("T", "H", "B", "?"), "T H B")],
    lambda: F.when(F.col("scope") == "title_only", text.text_scope("title_only")).when(F.col("scope") == "highlight_only", text.text_scope("highlight_only"))
    .when(F.col("scope") == "body_only", text.text_scope("body_only")).when(F.col("scope") == "all", text.text_scope("all")).otherwise(text.text_scope("?")),
)
golden(
    "dump_chunks", "value string",
    [
        (("1. toc\nTitel; krant\nde Telegraaf\n3 mei 2024\nBody\nTekst.\nEnd of Document\nniets\nBody",), [(0, "Titel; krant\nde Telegraaf\n3 mei 2024\nBody\nTekst.")]),
        (("a\nb\nc",), []),
        (("A; x\nb\nc\nBody d\nEnd of Document\n12. weg\nE\nf\n\ng\nBody\nh",), [(0, "A; x\nb\nc\nBody d"), (1, "E\nf\n\ng\nBody\nh")]),
    ],
    {"ordinal": "BIGINT", "chunk": "VARCHAR"}, lambda df: extract.split_dump(df).withColumn("ordinal", F.col("ordinal").cast("long")),
)
golden(
    "dump_fields", "chunk string",
    [
        (("Titel; krant\nde Telegraaf\n3 mei 2024 vrijdag\nSection: NIEUWS; p. 3\nByline: Door Jan Bos\nHighlight: Kort.\nBody\nEen zin met een punt.\nLoad-Date: x",),
         ("Titel", "3 mei 2024 vrijdag", "Door Jan Bos", "NIEUWS", "Kort.", "Een zin met een punt.\n")),
        (("Bodyguard vermist; AD\nAD\n4 mei 2024\nHighlight: De Bodyguard is weg\nBody\nDe tekst.",), ("Bodyguard vermist", "4 mei 2024", "", "", "De Bodyguard is weg", "De tekst.")),
        (("T\nk\nd\nSection: Sport\nBody x y",), ("T", "d", "", "", "", "x y")),
        (("T\nk\nd\nByline: Jan\n\nSection: Een; Twee\nHighlight: a\nb\n\n  Body\n\nc\n\nd",), ("T", "d", "Jan", "Een", "a\nb", "c\n\nd")),
    ],
    dict.fromkeys(("title", "date", "author", "section", "highlight", "full_text"), "VARCHAR"), lambda df: extract.extract_fields(df, "s"),
)
column(
    "author_lists", "t string",
    [(("",), ""), ((None,), ""), (("Door Jan Jansen",), "JAN JANSEN"), (("jan jansen en piet de vries",), "JAN JANSEN|PIET DE VRIES"), (("MEREL VAN BEERS TOM TACKEN",), "MEREL VAN BEERS|TOM TACKEN"),
     (("Jan (foto) Jansen, Utrecht",), "JAN|JANSEN"), (("jesper @ed.nl",), ""), (("foto",), ""), (("PIET KAMPEN",), "PIET K"), (("Jan Bos en jan bos",), "JAN BOS"), (("12 Saskia Smit",), "SASKIA SMIT"), (("Wafa Al / Ali",), "WAFA AL ALI")],
    lambda: joined(extract.clean_author("t")),
)
column("place_starts", "t string", [(("Steenwijk - De raad",), "De raad"), (("steenwijk de raad",), "steenwijk de raad"), (("Ter Apel: Een zin",), "Een zin"), (("Elders - De raad",), "Elders - De raad")], lambda: extract.strip_place(F.col("t")))
column(
    "dateline_starts", "t string",
    [(("AMSTERDAM - De trein rijdt.",), "De trein rijdt."), (("DEN HAAG (ANP): De minister",), "De minister"), (("UTRECHT De stad",), "De stad"), (("Gewone zin.",), "Gewone zin.")],
    lambda: extract.strip_cap_start(F.col("t")),
)
column(
    "clean_bodies", "t string",
    [((None,), ""), (("",), ""), (("Kop\n\nTussenkop\n\nEen zin met een punt.\n\nNog een.",), "Een zin met een punt.\n\nNog een."), (("AMSTERDAM - De trein rijdt.",), "De trein rijdt."),
     (("DEN HAAG (ANP): De minister zei het.",), "De minister zei het."), (("Een zin.\n\nBekijk de oorspronkelijke pagina: pagina 3\nrest",), "Een zin."),
     (("Een.\n\nkop een\n\nkop twee\n\nTwee.",), "Een.\n\nkop twee\n\nTwee."), (("Een zin.\n\nFictie\n\nTitel",), "Een zin."), (("Hij zei ,,hallo''.",), 'Hij zei "hallo".')],
    lambda: extract.clean_base("t"),
)
column(
    "clean_tabloid", "t string",
    [(("VROUW\n\nEen zin door Jan Jansen over iets. Bekijk de video bovenaan deze pagina.",), "Een zin over iets."), (("Zij zei: \"ja\".\n\nDan niet.",), 'Zij zei, "ja". Dan niet.'),
     (("Iets nieuws. Luister hier naar de podcast.",), "Iets nieuws.")],
    lambda: extract.clean_tabloid("t"),
)
golden(
    "clean_by_author", "t string, a array<string>",
    [(("Een zin.\n\nJan B. (Bos)", ["JAN B. (BOS)"]), ("Een zin.", "Een zin.\n\nJan B. (Bos)")), (("jan bos.\n\nEen zin.", ["JAN BOS."]), ("jan bos.\n\nEen zin.", "Een zin."))],
    {"ed": "VARCHAR", "dvhn": "VARCHAR"}, lambda df: df.withColumns({"ed": extract.clean_ed("t", "a"), "dvhn": extract.clean_dvhn("t", "a")}),
)
golden(
    "clean_local", "t string",
    [(("Steenwijk - De raad stemt.",), ("De raad stemt.", "De raad stemt.")), (("Uit het dorp is nieuws.\n\nDe raad stemt.",), ("Uit het dorp is nieuws.\n\nDe raad stemt.", "De raad stemt."))],
    {"stc": "VARCHAR", "nof": "VARCHAR"}, lambda df: df.withColumns({"stc": extract.clean_stc("t"), "nof": extract.clean_nof("t")}),
)
golden(
    "clean_articles", "source string, author string, date string, full_text string, highlight string",
    [
        (("de Telegraaf", "Door Jan Bos", "3 mei 2024 vrijdag", "Een zin met een punt.\n\nEn nog een.", "Kort."), ("JAN BOS", "03/05/2024", "Een zin met een punt. En nog een.", "Kort.")),
        (("Eindhovens Dagblad", "jan bos", "12 juni 2023", "Een zin.\n\nJan Bos", ""), ("JAN BOS", "12/06/2023", "Een zin.", "")),
        (("Nieuwsblad Noordoost-Friesland", "", "geen", "Uit het dorp is nieuws.\n\nDe raad stemt.", "Uit het dorp.\n\nX."), ("", "geen", "De raad stemt.", "X.")),
        (("Steenwijker Courant", "", "1 foo 2020", "Tuk - De raad stemt.", ""), ("", "01/01/2020", "De raad stemt.", "")),
        (("elders", "", "1 maart 2020", "Tuk - De raad stemt.", ""), ("", "01/03/2020", "Tuk - De raad stemt.", "")),
    ],
    dict.fromkeys(("author", "date", "full_text", "highlight"), "VARCHAR"), lambda df: extract.clean_articles(df).withColumn("author", joined("author")),
)

# --- junk ----------------------------------------------------------------------------------------------------------

_LONG = "woord " * 60
_TED = "Dagblad van het Noorden"
#: (title, text, source), (junk, recipe, agenda)
JUNK = [
    (("t", _LONG, "x"), (False, False, False)), (("t", "w " * 49, "x"), (True, False, False)), (("t", "w " * 50, "x"), (False, False, False)), (("Sudoku", _LONG, "x"), (True, False, False)),
    (("t", _LONG + "colofon", "x"), (True, False, False)), (("Recept: taart", _LONG, "x"), (True, True, False)), (("t", "Ingrediënten " + _LONG, "x"), (True, True, False)),
    (("t", _LONG + "snijd meng strooi", "x"), (True, True, False)), (("t", _LONG + "snijd meng", "x"), (False, False, False)),
    (("t", _LONG + "\n100 gram meel\n2 el suiker\n3 eetlepel olie", "x"), (True, True, False)), (("t", _LONG + " 11.00-17.00" * 4, "x"), (True, False, True)),
    (("t", _LONG + " 11.00-17.00" * 2, "x"), (False, False, False)), (("t", _LONG + " 11.00" * 5 + " entree excursie", "x"), (True, False, True)),
    (("t", _LONG + " 11.00" * 5 + " entree", "x"), (False, False, False)), (("Uitagenda", _LONG, "x"), (True, False, True)),
    (("t", "\n".join(["- " + "w " * 10] * 4 + ["w " * 10] * 3), "x"), (True, False, False)), (("t", "\n".join(["- " + "w " * 10] * 3 + ["w " * 10] * 3), "x"), (False, False, False)),
    (("t", "Hoeveel verdien je " + _LONG, "Eindhovens Dagblad"), (True, False, False)), (("t", "Hoeveel verdien je " + _LONG, "x"), (False, False, False)),
    (("t", "de uitslagen van " + _LONG, "Nieuwsblad Noordoost-Friesland"), (True, False, False)), (("t", "3 jan. \n\n" + _LONG, "Steenwijker Courant"), (True, False, False)),
    (("t", "3 jan. t/m 5 feb. \n\n" + _LONG, "Steenwijker Courant"), (True, False, False)), (("t", "3 jan. \n\n" + _LONG, "x"), (False, False, False)),
    (("t", _LONG + " stand voetbal " + _LONG, _TED), (True, False, False)), (("t", _LONG, _TED), (True, False, False)), (("t", _LONG + _LONG, _TED), (False, False, False)), (("t", "za " + _LONG + _LONG, _TED), (True, False, False)),
]
_ARTICLE = "title string, full_text string, source string"


def _articles(df: DataFrame) -> DataFrame:
    return df.withColumn("author", F.array().cast("array<string>"))


golden("junk_rules", _ARTICLE, JUNK, dict.fromkeys(("junk", "recipe", "agenda"), "BOOLEAN"), lambda df: _articles(df).withColumns({"junk": junk.is_junk(), "recipe": junk.is_recipe(), "agenda": junk.is_agenda()}))
Q["junk_dropped"] = lambda spark, sf_dir: junk.drop_junk(_articles(cased(spark, sf_dir, _ARTICLE, [i for i, _ in JUNK]))).select("doc_id")
SQL["junk_dropped"] = f"SELECT doc_id FROM documents WHERE doc_id % {len(JUNK)} IN ({', '.join(str(k) for k, (_, a) in enumerate(JUNK) if not a[0])})"
Q["junk_counts"] = lambda spark, sf_dir: junk.junk_counts(_articles(cased(spark, sf_dir, _ARTICLE, [i for i, _ in JUNK])))
SQL["junk_counts"] = f"""SELECT source, count(*) FILTER (WHERE NOT junk) AS kept, count(*) FILTER (WHERE junk) AS discarded FROM (SELECT doc_id, v.source, junk FROM documents
 JOIN (VALUES {', '.join(f"({k}, {literal(i[2])}, {literal(a[0])})" for k, (i, a) in enumerate(JUNK))}) AS v("case", source, junk) ON doc_id % {len(JUNK)} = "case") GROUP BY 1"""

# --- topics and models ---------------------------------------------------------------------------------------------


def _expected_prompt(body: str) -> str:
    listed = "\n".join(f"{i}: {t} ({d})" for i, (t, d) in enumerate(topics.TOPICS.items()))
    parts = [topics.INSTRUCTION.replace("{topics}", listed)]
    for t, a in topics.EXAMPLES:
        parts += ["Text to classify: " + t, a]
    return hashlib.md5("\n".join([*parts, "Text to classify: " + body, "Result ID:"]).encode()).hexdigest()


golden(
    "topic_prompts", "t string", [(("abc",), (_expected_prompt("abc"), 8)), ((None,), (_expected_prompt("No content"), 8)), (("é" * 1300,), (_expected_prompt("é" * 1200), 8))],
    {"md5": "VARCHAR", "turns": "BIGINT"}, lambda df: df.withColumns({"md5": F.md5(topics.prompt("t")), "turns": F.size(topics.messages("t")).cast("long")}),
)
golden(
    "keyword_topics", "full_text string, predicted_topic string",
    [(("sport athletes tournaments", None), ("sport",)), (("crime police court", None), ("crime, law and justice",)), (("", None), (None,)), (("sport athletes", "weather"), ("weather",))],
    {"predicted_topic": "VARCHAR"}, backends.classify,
)
column("gold_topics", "c string", [(('[[["medtop:01","b"],["x","c"]],[["medtop:15","a"],["medtop:01","b"]]]',), "a|b"), (("[]",), ""), (('[[["medtop:20000001","z"]]]',), "")], lambda: joined(topics.gold_labels(F.from_json("c", "array<array<array<string>>>"))))
golden(
    "topic_taxonomy", "m string", [(('{"1 - Head\\tz": ["2 - Sub\\tq", "3 - Other"]}',), [("Head", "Sub"), ("Head", "Other")])],
    {"head_topic": "VARCHAR", "sub_topic": "VARCHAR"}, lambda df: _taxonomy(df),
)


def _taxonomy(df: DataFrame) -> DataFrame:
    return df.select("doc_id").join(F.broadcast(topics.taxonomy(df.limit(1).select(F.from_json("m", "map<string,array<string>>").alias("mapping")))))


def _heads(df: DataFrame) -> DataFrame:
    pairs = [("H1", "a"), ("H1", "b"), ("H2", "c"), ("H2", "d")]
    return topics.subtopics_to_heads(df, df.sparkSession.createDataFrame(pairs, "head_topic string, sub_topic string"), "doc_id", "s")


golden(
    "subtopic_heads", "s string",
    [(("['a', 'c']",), ("H1", None)), (("['x', 'c', 'd']",), ("H2", None)), (("['c', 'a', 'b']",), ("H2", None)), (("['x']",), ("", None)), (("[]",), ("", None)), (("oops",), (None, "not a list of sub-topics"))],
    {"predicted_head_topic": "VARCHAR", "error": "VARCHAR"}, _heads,
)
golden(
    "rule_detector", "full_text string",
    [(("kort woord",), (10, 0.0, 0.0, 1.0, 0, None)), ((" ",), []), (("een — twee",), (10, 1.0, 1.0, 0.0, 1, None)), ((None,), [])],
    {"text_length": "BIGINT", "fraction_ai": "DOUBLE", "fraction_ai_assisted": "DOUBLE", "fraction_human": "DOUBLE", "num_ai_segments": "BIGINT", "error": "VARCHAR"},
    lambda df: backends.detect(df).withColumns({"text_length": F.col("text_length").cast("long"), "num_ai_segments": F.col("num_ai_segments").cast("long")}),
)
golden(
    "rule_annotator", "t string", [(("De hond is lief. Ja!",), ("DET NOUN AUX NOUN PUNCT NOUN PUNCT",)), (("",), (None,)), ((None,), (None,))], {"upos": "VARCHAR"},
    lambda df: backends.annotate(df, "t").withColumn("upos", F.array_join(F.transform(F.flatten("parsed_sentences"), lambda t: t["upos"]), " ")),
)

# --- AI use --------------------------------------------------------------------------------------------------------

_WIN = f"array<{schemas.WINDOW}>"
golden(
    "detector_windows", "w string",
    [
        (('[{"label":"a","ai_assistance_score":0.5,"confidence":"high","x":1},{"label":"b","confidence":"low"}]',), ('[{"label":"a","ai_assistance_score":0.5,"confidence":"high"},{"label":"b","confidence":"low"}]', 0.5)),
        (('[{"label":"a","ai_assistance_score":0.25},{"label":"b","ai_assistance_score":0.75}]',), ('[{"label":"a","ai_assistance_score":0.25},{"label":"b","ai_assistance_score":0.75}]', 0.5)),
        (("[]",), ("[]", None)), ((None,), (None, None)),
    ],
    {"kept": "VARCHAR", "score": "DOUBLE"},
    lambda df: df.withColumn("w", F.from_json("w", _WIN)).withColumns({"kept": F.to_json(ai_use.project_windows("w")), "score": ai_use.assistance_score("w")}),
)
_AI = "date string, section string, predicted_topic string, full_text string, fraction_ai double, fraction_ai_assisted double, w string"
_AI_ROWS = [
    (("1/1/2023", "Opinie", "sport", 'x "y z" — w', 1.0, 0.0, '[{"ai_assistance_score":0.5},{"label":"n"}]'), (True, True, "Opinie", "sport", "2023-Q1", "2023-Q1_and_after", 0.5, 4, 0.5)),
    (("31/12/2022", "", None, "", 0.0, 0.3, "[]"), (False, True, "Geen Sectie", "Geen Topic", "2022-Q4", "before_2023-Q1", None, 0, None)),
    (("2/2/2024", "s", "t", "a b", 0.0, 0.0, None), (False, False, "s", "t", "2024-Q1", "2023-Q1_and_after", None, 2, 0.0)),
    (("bad", "s", "t", "a", 0.1, 0.0, None), []), (("1/1/2024", "s", "t", "a", None, 0.0, None), []),
]


def _ai_frame(df: DataFrame) -> DataFrame:
    return df.withColumns({"windows": F.from_json("w", _WIN), "author": F.array().cast("array<string>")})


golden(
    "ai_frame", _AI, _AI_ROWS,
    {"is_ai_strict": "BOOLEAN", "is_ai_broad": "BOOLEAN", "section": "VARCHAR", "predicted_topic": "VARCHAR", "quarter": "VARCHAR", "period": "VARCHAR", "mean_ai_assistance_score": "DOUBLE", "total_words": "BIGINT", "quote_word_fraction": "DOUBLE"},
    lambda df: ai_use.build_frame(_ai_frame(df)).withColumn("total_words", F.col("total_words").cast("long")),
)
Q["ai_guards"] = lambda spark, sf_dir: ai_use.guard_counts(cased(spark, sf_dir, _AI, [i for i, _ in _AI_ROWS]))
SQL["ai_guards"] = 'SELECT count(*) AS "rows", count(*) FILTER (WHERE doc_id % 5 = 4) AS no_score, count(*) FILTER (WHERE doc_id % 5 = 3) AS bad_date FROM documents'
column(
    "opinion_sections", "source string, section string",
    [(("de Volkskrant", "Opinie"), True), (("Telegraaf", " WATUZEGT "), True), (("de Volkskrant", "Sport"), False), ((None, None), False), (("de Telegraaf", "opinie"), False), (("volkskrant", "opinie zaterdag"), True)],
    lambda: ai_use.is_opinion(), "BOOLEAN",
)
golden(
    "calendar_labels", "d string",
    [(("30/09/2020",), ("2020-Q3", 2020.5, "before_2023-Q1", "2020-09")), (("31/12/2022",), ("2022-Q4", 2022.75, "before_2023-Q1", "2022-12")), (("1/1/2023",), ("2023-Q1", 2023.0, "2023-Q1_and_after", "2023-01"))],
    {"quarter": "VARCHAR", "number": "DOUBLE", "period": "VARCHAR", "month": "VARCHAR"},
    lambda df: df.withColumn("p", text.parse_date("d")).withColumns({"quarter": text.quarter_label("p"), "number": text.quarter_number("p").cast("double"), "period": text.quarter_period("p"), "month": text.year_month("d")}),
)
golden("valid_dates", "d string", [(("31/02/2020",), (None,)), (("1/2/2020",), ("2020-02",)), (("",), (None,)), ((None,), (None,))], {"month": "VARCHAR"}, lambda df: df.withColumn("month", text.year_month("d")))

# --- metrics -------------------------------------------------------------------------------------------------------


def _tok(i: int, lemma: str | None, upos: str, head: int, deprel: str = "dep", feats: str | None = None) -> str:
    own = {"id": i, "text": lemma, "lemma": lemma, "upos": upos, "feats": feats, "deprel": deprel, "head": head}
    return "{" + ",".join(f'"{k}":{v}' if isinstance(v, int) else f'"{k}":"{v}"' for k, v in own.items() if v is not None) + "}"


_S1 = [_tok(1, "de", "DET", 2), _tok(2, "hond", "NOUN", 3), _tok(3, "lopen", "VERB", 0, "root", "VerbForm=Fin"), _tok(4, "waarheid", "NOUN", 3)]
_S2 = [_tok(1, "grondig", "ADV", 2), _tok(2, "zien", "VERB", 0, "root"), _tok(3, "en", "CCONJ", 4), _tok(4, "slapen", "VERB", 2, "conj"), _tok(5, ".", "PUNCT", 2), _tok(6, None, "X", 9)]
_CYCLE = [_tok(1, "a", "NOUN", 2), _tok(2, "b", "NOUN", 1)]
_parse = lambda *s: "[" + ",".join("[" + ",".join(x) + "]" for x in s) + "]"
_METRICS = ["freq_det", "freq_cconj", "freq_pronoun", "care_rigour_freq_per1k", "importance_freq_per1k", "mean_sent_len", "cv_sent_len", "mean_dep_depth", "finite_verbs_per_sent", "mean_tunit_len", "nom_rate", "mtld"]
golden(
    "parse_metrics", "title string, full_text string, p string",
    [
        (("Een  kop", "abc", _parse(_S1, _S2)), (10, 2, 2, 3, 100.0, 100.0, 0.0, 100.0, 0.0, 5.0, 0.2828, 2.0, 1.0, 3.5, 0.5, None)),
        ((None, None, None), (0, 0, 0, 0, *[None] * 12)), (("x", "", "[]"), (0, 0, 1, 0, *[None] * 12)),
        (("x", "ab", _parse(_CYCLE)), (2, 1, 1, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, None, 2.0, 1.0, 2.0, 0.0, None)),
    ],
    {**dict.fromkeys(("total_words", "total_sentences", "word_count_title", "char_count"), "BIGINT"), **dict.fromkeys(_METRICS, "DOUBLE")},
    lambda df: _metric_rows(df),
)


def _metric_rows(df: DataFrame) -> DataFrame:
    parsed = df.withColumn("parsed_sentences", F.from_json("p", metrics.PARSE))
    out = metrics.article_metrics(parsed, key="doc_id", title="title", text=F.col("full_text"), digits=4)
    return out.withColumns({c: F.col(c).cast("long") for c in ("total_words", "total_sentences", "word_count_title", "char_count")})


column("lemma_diversity", "l array<string>", [((["a"] * 60,), 2.0), ((["a", "b"] * 30,), 3.0), ((["a"] * 49,), None), (([],), None)], lambda: metrics.mtld("l"), "DOUBLE")
column("content_words", "p string", [((_parse(_S1, _S2),), "hond|lopen|waarheid|grondig|zien|slapen"), ((None,), ""), ((_parse(_CYCLE),), "a|b")], lambda: joined(metrics.content_lemmas(F.from_json("p", metrics.PARSE))))
golden(
    "frequency_rows", "_c0 string, _c1 string",
    [(("hond N(soort,ev)", "10"), ("hond", "NOUN", 10)), (("x", "5"), []), (("kat Q(x)", "z"), []), (("lopen WW(inf)", " 30 "), ("lopen", "VERB", 30)), (("raar XYZ(q)", "2"), ("raar", "X", 2)), (("", None), [])],
    {"lemma": "VARCHAR", "upos": "VARCHAR", "frequency": "BIGINT"}, lambda df: _frequencies(df),
)


def _frequencies(df: DataFrame) -> DataFrame:
    found = files.frequency_list(df.select("_c0", "_c1").distinct())
    return df.join(F.broadcast(found), F.split("_c0", " ")[0] == found["lemma"])


# --- shift, panels, figures ----------------------------------------------------------------------------------------

column(
    "corpus_periods", "d string",
    [(("2022-11-30",), "pre"), (("2022-12-01",), None), (("2023-06-01",), None), (("2024-01-01",), "post"), (("2025-12-31",), "post"), (("2020-12-31",), None), (("2021-01-01",), "pre")],
    lambda: shift.period_of(F.col("d").cast("date")),
)
column("p_stars", "p double", [((0.0005,), "***"), ((0.005,), "**"), ((0.03,), "*"), ((0.05,), "ns"), ((None,), "ns")], lambda: stats.stars("p"))
golden(
    "shift_rates", "pre double, post double, n1 double, n2 double",
    [((10.0, 20.0, 100.0, 100.0), (100_000.0, 200_000.0, 100.0, 3.921569)), ((0.0, 5.0, 100.0, 100.0), (0.0, 50_000.0, None, 5.128205)), ((0.0, 0.0, 0.0, 10.0), (0.0, 0.0, None, 0.0))],
    dict.fromkeys(("pre_ppm", "post_ppm", "change", "chi2"), "DOUBLE"),
    lambda df: df.withColumns({"pre_ppm": stats.ppm("pre", "n1"), "post_ppm": stats.ppm("post", "n2")}).withColumns(
        {"change": F.round(stats.pct_change("pre_ppm", "post_ppm"), 6), "chi2": F.round(stats.chi2_2x2(F.col("pre"), F.col("post"), F.col("n1"), F.col("n2")), 6)}),
)
golden(
    "first_authors", "author string, outlet string",
    [(("Jan; Piet", "vk"), ("Jan", "vk::Jan")), ((None, "vk"), (None, "vk::NA")), ((" ", "ed"), (None, "ed::NA")), (("Saskia", "ed"), ("Saskia", "ed::Saskia"))],
    {"author_clean": "VARCHAR", "journalist_id": "VARCHAR"}, panel.journalists,
)
_NAMES = ["mtld", "x", "baseline_word_20", "a_freq_per1k", "freq_det", "llm_style_word_50", "freq_adp"]
golden(
    "metric_directions", "metric string", [((m,), d) for m, d in zip(_NAMES, [(-1, True), (1, False), (0, True), (1, True), (1, True), (1, True), (0, True)])],
    {"direction": "BIGINT", "is_metric": "BOOLEAN"},
    lambda df: df.withColumns({"direction": panel.direction_column("metric").cast("long"), "is_metric": F.col("metric").isin(panel.metric_columns(_NAMES))}),
)
column("flagged_labels", "s boolean, k boolean", [((True, True), "Sig. (correct dir.)"), ((True, False), "Sig. (wrong dir.)"), ((False, True), "Not significant"), ((False, False), "Not significant")], lambda: figures.flagged_label("s", "k"))
golden(
    "split_points", "g string, n_seeds int, ai_pct_change double, baseline_pct_change double",
    [(("vk", 20, 12.5, -1.0), [("vk", 20, "ai", 12.5), ("vk", 20, "baseline", -1.0)]), (("(pooled)", 20, 1.0, 1.0), []), (("ed", 50, None, 3.0), [("ed", 50, "baseline", 3.0)])],
    {"g": "VARCHAR", "n_seeds": "BIGINT", "word_set": "VARCHAR", "pct_change": "DOUBLE"}, lambda df: _points(df),
)


def _points(df: DataFrame) -> DataFrame:
    points = figures.split_points(df.select("g", "n_seeds", "ai_pct_change", "baseline_pct_change").distinct(), "g")
    return df.select("doc_id", F.col("g").alias("own")).join(F.broadcast(points), F.col("own") == F.col("g")).withColumn("n_seeds", F.col("n_seeds").cast("long"))


golden(
    "forest_rows", "term string, estimate double, std_error double",
    [(("intervention:outlet_typelocal", 1.0, 0.5), ("intervention × local", 0.020018, 1.979982)), (("time", 1.0, 0.5), []), (("outlet_typeregional", -1.0, 0.0), ("regional", -1.0, -1.0)), (("intervention", 0.0, 1.0), ("intervention", -1.959964, 1.959964))],
    {"term_clean": "VARCHAR", "conf_low": "DOUBLE", "conf_high": "DOUBLE"}, lambda df: figures.forest(df).withColumns({k: F.round(k, 6) for k in ("conf_low", "conf_high")}),
)
