"""Topic prompts, response parsing, balancing and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import c, first_of, year_month

#: Topics in the order of their ids, with descriptions.
TOPICS = {
    "arts, culture, entertainment and media": "Events and issues related to artistic expression, celebrities, movies, and the arts.",
    "crime, law and justice": "Illegal acts, police investigations, court cases, and the legal system.",
    "disaster, accident and emergency incident": "Natural disasters, transport accidents, and emergency services responses.",
    "economy, business and finance": "Market news, company performance, banking, and macroeconomics.",
    "education": "Schools, universities, teaching, and learning policies.",
    "environment": "Climate change, nature conservation, pollution, and ecology.",
    "health": "Medical research, diseases, public health, and wellness.",
    "human interest": "Emotional stories about people, animals, or quirky events.",
    "labour": "Employment, trade unions, strikes, and workplace issues.",
    "lifestyle and leisure": "Travel, hobbies, fashion, and personal habits.",
    "politics": "Government, elections, legislation, and political parties.",
    "religion and belief": "Faith, religious organizations, and spiritual practices.",
    "science and technology": "Inventions, scientific discoveries, and technical developments.",
    "society": "Social issues, demographics, welfare, and community groups.",
    "sport": "Competitive physical activities, athletes, and tournaments.",
    "conflict, war and peace": "Armed conflict, military operations, and peace negotiations.",
    "weather": "Meteorological conditions, forecasts, and extreme weather patterns.",
}


#: The instruction, the lead of a text, the lead of the answer, and the three example pairs.
INSTRUCTION = (
    "You are an expert news classifier. Input language: Dutch.\n"
    "Categorize the text into exactly ONE topic by providing its ID number.\n\n"
    "TOPIC LIST:\n{topics}\n\nResponse format: Return ONLY the number. NO THINKING."
)
ASK, ANSWER = "Text to classify: ", "Result ID:"
EXAMPLES = [
    ("Spaanse politie onderschept recordvangst cocaïne verstopt in lading bananen : Grootste ooit in Europa De Spaanse politie en beambten van de douane vonden onlangs maar liefst negen ton cocaïne in een lading bananen die uit Colombia werd geïmporteerd .", "1"),
    ("Seehofer verliest van Merkel CSU-voorzitter Horst Seehofer was gisteravond van plan ontslag te nemen als partijvoorzitter en minister . Partijgenoten probeerden hem om te praten .", "10"),
    ("Dodelijke aanval op havenstad in Jemen hodeida De coalitie onder leiding van Saoedi-Arabië heeft gisteren een offensief geopend op de havenstad Hodeida in Jemen . Het is de grootste operatie in de nu al drie jaar aanslepende oorlog .", "15"),
]


def messages(text: Column | str, examples: list[tuple[str, str]] = EXAMPLES, limit: int = 1200) -> Column:
    """The chat of a text as array<struct<role, content>>: the instruction with the numbered topics, the examples as
    turns, and the first ``limit`` characters of the text (No content for null)."""
    topics = "\n".join(f"{i}: {t} ({d})" for i, (t, d) in enumerate(TOPICS.items()))
    turns = [("system", INSTRUCTION.format(topics=topics))]
    for t, a in examples:
        turns += [("user", ASK + t), ("assistant", a)]
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.substring(F.coalesce(c(text), F.lit("No content")), 1, limit)
    return F.array(*[said(r, F.lit(x)) for r, x in turns], said("user", F.concat(F.lit(ASK), body)))


def prompt(text: Column | str, examples: list[tuple[str, str]] = EXAMPLES, limit: int = 1200) -> Column:
    """messages() as one text for models without a chat template, ending in the lead of the answer."""
    return F.concat(F.array_join(F.transform(messages(text, examples, limit), lambda m: m["content"]), "\n"), F.lit("\n" + ANSWER))


def parse_response(response: Column | str) -> Column:
    """The first integer if it is a topic's id, else the first topic whose label or first word occurs, else null."""
    r = c(response)
    number = F.try_cast(F.nullif(F.regexp_extract(r, r"\d+", 0), F.lit("")), "int") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(r, r"\d+", 0), F.lit("")).try_cast("int")
    names = F.array(*[F.lit(t) for t in TOPICS])
    by_id = F.when(number.between(0, len(TOPICS) - 1), F.get(names, number))
    low = F.lower(r)
    by_word = first_of("", *[(low.contains(t) | low.contains(t.split(",")[0].split(" ")[0]), t) for t in TOPICS])
    return F.coalesce(by_id, F.nullif(by_word, F.lit("")))


# --- balancing -----------------------------------------------------------------------------------------------------


def topic_averages(df: DataFrame, source: str = "source", topic: str = "predicted_topic", month: Column | None = None) -> DataFrame:
    """Per source and topic: months_present, total_articles, avg_per_month over the months in which it occurs."""
    month = year_month("date") if month is None else month
    valid = df.withColumn("__m", month).where(F.col("__m").isNotNull() & (F.trim(F.col(topic)) != ""))
    monthly = valid.groupBy(source, topic, "__m").agg(F.count("*").alias("n"))
    return monthly.groupBy(source, topic).agg(
        F.count("*").alias("months_present"), F.sum("n").alias("total_articles"), F.avg("n").alias("avg_per_month")
    )


def balance_topics(df: DataFrame, threshold: float = 15, source: str = "source", topic: str = "predicted_topic", month: Column | None = None) -> DataFrame:
    """Rows with a valid date whose topic averages at least ``threshold`` a month in its source."""
    kept = topic_averages(df, source, topic, month).where(F.col("avg_per_month") >= threshold).select(source, topic)
    valid = df.where((year_month("date") if month is None else month).isNotNull())
    return valid.join(kept, [source, topic], "left_semi")


def topic_summary(df: DataFrame, threshold: float = 15, **names) -> DataFrame:
    kept = F.when(F.col("avg_per_month") >= threshold, "yes").otherwise("no")
    return topic_averages(df, **names).withColumn("kept", kept)


# --- evaluation ----------------------------------------------------------------------------------------------------


def gold_labels(codes: Column | str) -> Column:
    """Distinct labels of [code, label] pairs whose code starts with medtop:0 or medtop:1, in order."""
    pairs = F.filter(F.flatten(c(codes)), lambda p: p[0].rlike("^medtop:[01]"))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[1])))


def taxonomy(df: DataFrame, mapping: str = "mapping") -> DataFrame:
    """(head_topic, sub_topic) from a map of entries like 'code - name<tab>...'."""
    name = lambda x: F.trim(F.regexp_extract(x, r"-\s*([^\t]+)", 1))
    heads = df.select(F.explode(mapping).alias("h", "subs"))
    return heads.select(name(F.col("h")).alias("head_topic"), F.explode("subs").alias("s")).select("head_topic", name(F.col("s")).alias("sub_topic"))


def reciprocal_rank_vote(df: DataFrame, key: str, position: str, label: str) -> DataFrame:
    """The label with the largest sum of 1 / (position + 1) per key; the one seen first wins ties."""
    votes = df.groupBy(key, label).agg(F.sum(F.lit(1.0) / (F.col(position) + 1)).alias("score"), F.min(position).alias("first"))
    best = F.min(F.struct(-F.round("score", 9), F.col("first"), F.col(label).alias("label"), F.col("score")))
    return votes.groupBy(key).agg(best.alias("b")).select(key, F.col("b.label").alias("head_topic"), F.col("b.score").alias("score"))


def subtopics_to_heads(df: DataFrame, mapping: DataFrame, key: str, subtopics: str) -> DataFrame:
    """df with predicted_head_topic by reciprocal-rank vote over a list literal of sub-topics, best first.

    ``mapping`` is taxonomy()'s (head_topic, sub_topic).  A list without any known sub-topic gives an empty text; what is
    no list gives null and a text in ``error``.  ``key`` is unique."""
    parsed = F.from_json(F.replace(F.col(subtopics), F.lit("'"), F.lit('"')), "array<string>")
    rows = df.select(F.col(key).alias("__key"), F.posexplode(parsed).alias("__i", "sub_topic"))
    known = mapping.select("head_topic", "sub_topic").dropDuplicates(["sub_topic"])
    votes = reciprocal_rank_vote(rows.join(known, "sub_topic"), "__key", "__i", "head_topic").select(F.col("__key").alias(key), F.col("head_topic").alias("__head"))
    bad = parsed.isNull()
    out = df.join(votes, key, "left").withColumns({
        "predicted_head_topic": F.when(~bad, F.coalesce("__head", F.lit(""))), "error": F.when(bad, F.lit("not a list of sub-topics")),
    })
    return out.drop("__head")


def any_match_accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    hit = F.coalesce(F.array_contains(F.col(gold), F.col(predicted)), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.avg(hit.cast("int")).alias("accuracy"))


def label_counts(df: DataFrame, key: str, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn per label of the gold universe; gold and predicted are arrays."""
    t = df.select(key, F.explode(F.array_distinct(gold)).alias("label")).withColumn("t", F.lit(1))
    p = df.select(key, F.explode(F.array_distinct(predicted)).alias("label")).withColumn("p", F.lit(1))
    both = t.join(p, [key, "label"], "full_outer")
    counts = both.groupBy("label").agg(
        F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
    )
    return counts.where(F.col("tp") + F.col("fn") > 0)


def multilabel_f1(df: DataFrame, key: str, gold: str, predicted: str) -> DataFrame:
    per = label_counts(df, key, gold, predicted)
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    total = lambda x: F.sum(x)
    micro = 2.0 * total("tp") / F.nullif(2 * total("tp") + total("fp") + total("fn"), F.lit(0))
    return per.agg(F.coalesce(micro, F.lit(0.0)).alias("micro_f1"), F.avg(f1).alias("macro_f1"))


def confusion(df: DataFrame, gold: str, predicted: str, normalize: bool = False) -> DataFrame:
    """Long form: one count per gold label and prediction; missing ones are named."""
    rows = df.select(F.coalesce(F.col(predicted), F.lit("<NO_PRED>")).alias("predicted"), F.explode_outer(gold).alias("g"))
    rows = rows.select(F.coalesce("g", F.lit("<NO_TRUE_LABEL>")).alias("gold"), "predicted")
    out = rows.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    if normalize:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold")))
    return out


def confusion_matrix(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    return confusion(df, gold, predicted).groupBy("gold").pivot("predicted", labels).agg(F.sum("n")).na.fill(0)
