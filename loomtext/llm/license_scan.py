"""License scan by an exact set-similarity join, in DataFrame operations only.

A text block is a run of consecutive words, ``stretch`` times as many as a license template has; line ends don't
matter, so a notice that is wrapped over lines is one block and words scattered over a long line are none.  A block
meets a template if it holds at least ``threshold`` of the template's different words.  The join is a prefix-filter
join: the words of all templates are ordered by how many documents hold them, rarest first; with m template words of
which o must be found, the first one that a block shares is one of the first m - o + 1.  So every place of such a
word, with the words around it, is joined with the templates that have it in their prefix.  Candidates pass a length
filter (the words around hold at least o template words) and a positional filter (so do those that follow the shared
word in the order), and the blocks around the place are then compared one by one.

The templates are a parameter of bounded size; their word counts are the only thing that comes to the driver.  Whole
documents are read for the counts, for the base phrases and, where a prefix word occurs, for the blocks; only places
of prefix words are shuffled.

Defined cases: null text has no words, no labels and score 0; repeated rows give a row each with equal results;
ties in the word order fall to the word; ids that are no integers are refused; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, key_id

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Usual wordings of license notices, with their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("public-domain", "this work has been dedicated to the public domain"),
    ("reserved", "all rights reserved"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def _words(text: Column) -> Column:
    """Lower-cased words as an array; none for null or empty text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEP), lambda w: w != "")


def _phrase_regex(phrases: list[str]) -> str:
    """Any of the phrases as whole words, ASCII letters in either case."""
    return f"(?i)(?<!{_WORD})(?:" + "|".join(p.replace(" ", _SEP) for p in sorted(phrases)) + f")(?!{_WORD})"


def _starts(words: Column, phrase: str) -> Column:
    """Positions where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == p)
        return test

    return F.filter(places, here)


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = 0.9,
    stretch: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, places (start positions and labels of the base phrases), hits (matched templates:
    template, label, the best block's containment and the word where the first such block starts) and score, the best
    containment."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    vocabulary = sorted({w for _, t in sets for w in t})

    # global frequency order: document counts of the template words, over all documents
    split = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _SEP)
    counted = rows.select(F.explode(F.array_intersect(split, F.array(*map(F.lit, vocabulary)))).alias("w"))
    df = {r.w: r.n for r in counted.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most one row per template word
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index = []
    for k, (label, t) in enumerate(sets):
        ranks = sorted(rank[w] for w in t)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        width = stretch * len(templates[k][1].split())
        index += [(r, k, label, i, ranks, need, width) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefix = spark.createDataFrame(index, "rank int, template int, label string, i int, t_ranks array<int>, need int, width int")

    first_words = sorted({order[r[0]] for r in index})
    reach = max(r[6] for r in index) - 1  # words on either side of a place that a block around it can hold
    rank_map = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    firsts = F.array(*[F.lit(rank[w]) for w in first_words])
    ranked = F.transform(_words(F.col("text")), lambda w: F.coalesce(F.try_element_at(rank_map, w), F.lit(-1)))
    at = F.filter(F.transform("r", lambda r, i: F.when(F.array_contains(firsts, r), i)), lambda i: i.isNotNull())
    around = lambda i: F.struct(
        i.alias("at"), F.get("r", i).alias("rank"), F.greatest(i - reach, F.lit(0)).alias("begin"),
        F.slice("r", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + 1 + reach).alias("near"),
    )
    places_of = (
        rows.where(F.col("text").rlike(_phrase_regex(first_words))).distinct()
        .select("k1", "k2", ranked.alias("r")).select("k1", "k2", F.explode(F.transform(at, around)).alias("p")).select("k1", "k2", "p.*")
    )
    t_ranks, need = F.col("t_ranks"), F.col("need")
    shared = F.array_intersect("near", "t_ranks")
    # the blocks that hold the place: those that begin width - 1 words before it and later, as far as the text goes
    starts = F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), F.col("at"))
    block = lambda s: F.slice("near", s - F.col("begin") + 1, F.col("width"))
    holds = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(block(s), t_ranks)).alias("overlap"), (-s).alias("s")))
    pairs = (
        places_of.join(F.broadcast(prefix), "rank")  # a few rows for each template
        .where(F.size(shared) >= need)
        .where(F.size(F.filter(shared, lambda r: r >= F.col("rank"))) >= need)
        .withColumn("best", F.array_max(holds))
        .where(F.col("best.overlap") >= need)
    )
    best = pairs.groupBy("k1", "k2", "template", "label").agg(F.max("best").alias("best"), F.first(F.size("t_ranks")).alias("m"))
    hits = best.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.struct("template", "label", (F.col("best.overlap") / F.col("m")).alias("containment"), (-F.col("best.s")).alias("start")))).alias("hits"),
    )

    words = _words(F.col("text"))
    found = F.coalesce(F.col("text").rlike(_phrase_regex(list(phrases))), F.lit(False))
    places = F.concat(*[_labelled(_starts(F.col("words"), p), label) for p, label in phrases.items()])
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    base = rows.select(
        "k1", "k2",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"{_WORD}+")).cast("long").alias("n_words"),
        F.when(found, words).alias("words"),
    ).select("k1", "k2", "n_words", F.when(F.col("words").isNull(), none).otherwise(places).alias("places"))
    return base.join(hits, ["k1", "k2"], "left").select(
        key_id("k1").alias("doc_id"), "n_words", "places",
        F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    mine = F.transform("hits", lambda h: h["label"])
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, mine)).alias("labels"), "score",
    )
