"""Junk predicates: boolean columns, true where a record should go.  Tests are substring tests on lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, hits, starts_with_any, word_count

#: Recipe cues.
RECIPE_TITLES = ["recept:", "recept van de dag", "koken:"]
RECIPE_STARTS = ["ingrediënten", "je hebt nodig", "bereiding", "nodig:"]
RECIPE_WORDS = [
    "ingrediënten", "bereidingswijze", "bereidingstijd", "kooktijd", "snijd", "meng", "voeg toe", "verwarm de oven",
    "eetlepel", "theelepel", "bakplaat", "koekenpan", "scheutje", "garneer", "bereiding", "strooi", "verhit", "braad",
    "gram", "ml ",
]
#: A line of ingredients.
INGREDIENT = r"(?m)^\s*\d+(?:[.,]\d+)?\s*(?:gram|gr|ml|liter|el|tl|eetlepel|theelepel|stuks?|teentjes?|snufje)\s+[a-z]+"
#: Agenda cues.
AGENDA_TITLES = ["agenda", "uitagenda", "evenementen", "wat is er te doen", "weekend", "tips"]
AGENDA_WORDS = ["opg.", "entree", "excursie", "stadswandeling", "aanmelden via", "organist; klassiek", "o.l.v."]
#: A span of times, a time.
TIME_BLOCK = r"(?U)\b\d{1,2}[:.]\d{2}\s*-\s*\d{1,2}[:.]\d{2}\b"
TIME = r"(?U)\b\d{1,2}[:.]\d{2}\b"
#: Other titles and starts.
PUZZLES = ["puzzel", "sudoku", "kruiswoord"]
TITLES = ["de ommezwaai", "op rapport", "net op de wereld", "jarig"]
DVHN_STARTS = ["ingrediënten", "je hebt nodig", "za ", "adres lübeckweg", "reageren?\n\n"]
SPORT_LISTS = ["uitslagen", "programma", "stand", "topscorers"]
SPORTS = ["voetbal", "basketbal", "hockey", "sport"]


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def is_recipe(title: str = "title", text: str = "full_text") -> Column:
    t, x = _low(title), _low(text)
    lines = F.regexp_count(x, F.lit(INGREDIENT)) >= 3
    return contains_any(t, RECIPE_TITLES) | starts_with_any(x, RECIPE_STARTS) | (hits(x, RECIPE_WORDS) >= 3) | lines


def is_agenda(title: str = "title", text: str = "full_text") -> Column:
    t, x = _low(title), F.coalesce(F.col(text), F.lit(""))
    times = (F.regexp_count(x, F.lit(TIME)) >= 5) & (hits(F.lower(x), AGENDA_WORDS) >= 2)
    return contains_any(t, AGENDA_TITLES) | (F.regexp_count(x, F.lit(TIME_BLOCK)) >= 4) | times


def is_short(text: str = "full_text", words: int = 50) -> Column:
    return word_count(text) < words


def is_enumeration(text: str = "full_text") -> Column:
    """More than five lines, more than half of them beginning with a digit, a dash or a star."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), F.trim), lambda v: v != "")
    marked = F.size(F.filter(lines, lambda v: v.rlike(r"^[\d\-*]")))
    return (F.size(lines) > 5) & (marked * 2 > F.size(lines))


def is_puzzle(title: str = "title", text: str = "full_text") -> Column:
    x = _low(text)
    return contains_any(_low(title), PUZZLES) | (x.contains("horizontaal:") & x.contains("verticaal:"))


def is_colophon(title: str = "title", text: str = "full_text") -> Column:
    return _low(title).contains("colofon") | _low(text).contains("colofon")


def junk_base(title: str = "title", text: str = "full_text") -> Column:
    return (
        is_short(text) | is_enumeration(text) | is_puzzle(title, text) | is_colophon(title, text) | is_recipe(title, text)
        | is_agenda(title, text) | contains_any(_low(title), TITLES)
    )


def junk_dvhn(text: str = "full_text", author: str = "author") -> Column:
    x = _low(text)
    bare = (F.coalesce(F.size(F.col(author)), F.lit(0)) <= 0) & (word_count(text) < 100)
    return bare | starts_with_any(x, DVHN_STARTS) | (contains_any(x, SPORT_LISTS) & contains_any(x, SPORTS))


def junk_stc(text: str = "full_text") -> Column:
    day = r"\d{1,2}\s+[a-z]{3}\."
    x = _low(text)
    return x.rlike(rf"\A{day}\s*\n\n") | x.rlike(rf"\A{day}\s+t/m\s+{day}\s*\n\n") | x.startswith("de namen van eindexamenkandidaten die geslaagd")


def is_junk(source: str = "source") -> Column:
    """The base rules or those of the row's source."""
    s, x = F.col(source), _low("full_text")
    own = (
        F.when(s == "Dagblad van het Noorden", junk_dvhn())
        .when(s == "Eindhovens Dagblad", x.startswith("hoeveel verdien je"))
        .when(s == "Steenwijker Courant", junk_stc())
        .when(s == "Nieuwsblad Noordoost-Friesland", starts_with_any(x, ["de resultaten van", "de uitslagen van"]))
        .otherwise(F.lit(False))
    )
    return junk_base() | own


def drop_junk(df: DataFrame) -> DataFrame:
    return df.where(~is_junk())


def junk_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count_if(~is_junk()).alias("kept"), F.count_if(is_junk()).alias("discarded"))
