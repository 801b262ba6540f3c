"""Field extraction from raw article dumps and per-source cleaning, as Catalyst string expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import c, format_date_nl, let, normalize_quotes, strip

#: Phrases before an author's name.
AUTHOR_PREFIXES = [
    "onze redacteur", "onze verslaggever", "onze verslaggevers", "onze correspondente", "onze correpsondente", "by",
    "door", "tekst", "redactie",
]
#: Name connectors.
CONNECTORS = ["VAN", "DE", "DER", "DEN", "HET", "IN", "TE", "VAN'T", "VANDEN", "VANDE", "V.D.", "VD"]
#: Words that are no author.
AUTHOR_KEYWORDS = [
    "illustratie", "foto", "foto's", "beeld", "verslaggeving", "graphics", "infographic", "onze correspondent",
    "onze verslaggever", "onze verslaggevers", "onze redacteur", "onze correspondente", "onze correpsondente", "redactie",
    "tekst", "door", "by", "getty", "warschau", "en foto", "en foto's",
]
#: Names that the split separates, first and second part.
GLUED = [("VAN ERVEN", "DORENS"), ("AMANDA BULTHUIS", "OERLEMANS"), ("JOHN", "PAUL"), ("WAFA AL", "ALI")]
#: Places that open a dateline.
PLACES = [
    "Dhaka", "Zandvoort", "Apeldoorn", "Ter Apel", "Havelte", "Kuinre", "Sint Jansklooster", "Scheerwolde", "Steenwijk",
    "Steenwjkerwold", "Kalenberg", "Tuk", "Steenwijkerland", "Belt-Schutsloot", "Diever", "Staphorst", "Vledder",
    "Zuidwolde", "Willemsoord", "Basse", "Kallenkote", "Dwingeloo", "Feanwalden", "Kollum", "De Westereen", "Burdaard",
    "Ternaard", "Buitenpost", "Lauwersoog", "Reitsum", "Hantumhuzen", "Surhuisterveen", "Holwerd", "Driezum", "Paezens",
    "Westergeast", "Bartlehiem", "Warfstermolen", "Ingwierrum", "Stadskanaal",
]

_UP = "A-ZÄËÏÖÜÁÉÍÓÚÀÈÌÒÙ"
_LOW = "a-zäëïöüáéíóúàèìòù"


def split_dump(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per document of a whole-text dump: its other columns, ordinal, chunk.  Table-of-contents lines go; chunks
    need the word Body and three lines."""
    others = [F.col(f"`{k}`") for k in df.columns if k != text]
    chunks = df.select(*others, F.posexplode(F.split(F.col(text), "End of Document")).alias("ordinal", "chunk"))
    chunk = strip(F.regexp_replace("chunk", r"(?m)^\d+\.\s+.*$", ""))
    lines = F.filter(F.split("chunk", "\n"), lambda x: F.trim(x) != "")
    return chunks.withColumn("chunk", chunk).where(F.col("chunk").contains("Body") & (F.size(lines) >= 3))


#: The marks of a dump's fields.  The highlight ends before a line that begins with Body, the body begins
#: at the first Body that white space follows.
FIELDS = {
    "author": r"(?dU)Byline:\s*(.*?)(?:\n|\z)",
    "section": r"(?dU)Section:\s*(.*?)(?:;|$)",
    "highlight": r"(?dsU)Highlight:\s*(.*?)(?=\n\s*Body|\z)",
    "full_text": r"(?dsU)Body\s+(.*?)(?=Load-Date:|\z)",
}


def extract_fields(df: DataFrame, source: str, chunk: str = "chunk") -> DataFrame:
    """Title, date, section, author, highlight and body of each chunk; absent fields are empty."""
    x = F.col(chunk)
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda v: v != "")
    return df.select(
        *[k for k in df.columns if k != chunk],
        strip(F.split(F.get(lines, F.lit(0)), ";")[0]).alias("title"),
        F.lit(source).alias("source"),
        F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("date"),
        *[F.regexp_extract(x, pattern, 1).alias(name) for name, pattern in FIELDS.items()],
    )


# --- authors -------------------------------------------------------------------------------------------------------


def _any(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def clean_author(raw: Column | str) -> Column:
    """Cleaned, upper-cased author names as an array without repeats."""
    x = F.regexp_replace(strip(F.coalesce(c(raw), F.lit(""))), r"[./ ]+$", "")
    x = F.regexp_replace(x, rf"(?iu)^({_any(AUTHOR_PREFIXES)})\s*[:\-]?\s+", "")
    parts = F.split(x, r"(?iu)\s+en\s+|\s*&\s*|\s*/\s*|\s*amp\s*|\s{2,}")
    names = F.flatten(F.transform(parts, _two_names))
    names = F.filter(F.transform(names, _clean_name), _is_name)
    for pair in GLUED:
        names = let(names, _glue(*pair))
    return F.array_distinct(F.transform(names, F.upper))


def _glue(a: str, b: str):
    """Join the first two names if they are the parts a and b (a may end a longer name)."""

    def f(names: Column) -> Column:
        first, second = F.upper(F.get(names, F.lit(0))), F.upper(F.get(names, F.lit(1)))
        joined = F.concat(F.array(F.concat_ws(" ", F.slice(names, 1, 2))), F.slice(names, 3, 1_000))
        begins = first.endswith(a) if a == "VAN ERVEN" else first == a
        return F.when((F.size(names) >= 2) & begins & (second == b), joined).otherwise(names)

    return f


def _two_names(entry: Column) -> Column:
    """Four words and more: cut before the first word that, like the one before it, is no connector."""
    no = F.array(*[F.lit(w) for w in CONNECTORS])

    def cut(words: Column) -> Column:
        def here(i: Column) -> Column:
            now, before = F.upper(F.get(words, i)), F.upper(F.get(words, i - 1))
            return ~F.array_contains(no, now) & ~F.array_contains(no, before) & ~((before == "ERVEN") & (now == "DORENS"))

        n = F.size(words)
        at = F.get(F.filter(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), here), F.lit(0))
        halves = lambda k: F.array(F.concat_ws(" ", F.slice(words, F.lit(1), k)), F.concat_ws(" ", F.slice(words, k + 1, n)))
        return let(F.when(n >= 4, at), lambda k: F.when(k.isNotNull(), halves(k)).otherwise(F.array(entry)))

    return let(F.filter(F.split(entry, r"\s+"), lambda w: w != ""), cut)


def _clean_name(x: Column) -> Column:
    """One name: its dashes, brackets, keywords, e-mail address and number go."""
    keys = _any(AUTHOR_KEYWORDS)
    x = F.regexp_replace(strip(x), r"^[- ]+", "")
    x = F.regexp_replace(x, r"\(.*?\)", "")
    x = F.trim(F.regexp_replace(x, rf"(?iu)^({keys})s?[:\s\-]+", ""))
    x = F.trim(F.regexp_replace(x, rf"(?iu)\s+({keys})s?[:\s\-].*$", ""))
    x = F.trim(F.split(x, ",")[0])
    x = F.trim(F.regexp_replace(x, r"(?U)[\w.\-]+\s*@\s*[\w.\-]+.*$", ""))
    return F.regexp_replace(x, r"^\d+\s+", "")


def _is_name(x: Column) -> Column:
    bare = F.regexp_replace(F.lower(x), "s+$", "")
    return ~x.contains(":") & (F.regexp_count(x, F.lit(r"\S+")) <= 5) & ~bare.isin(AUTHOR_KEYWORDS) & (F.length(x) > 2)


# --- datelines and bodies ------------------------------------------------------------------------------------------


def strip_place(x: Column) -> Column:
    """Drop a known place at the start if what follows it begins upper-case (the native form of an entity ruler)."""
    places = "|".join(f"\\Q{p}\\E" for p in sorted(PLACES, key=len, reverse=True))
    return F.regexp_replace(x, rf"\A(?iu:{places})(?U:\W*)(?=\p{{Lu}})", "")


def strip_cap_start(x: Column) -> Column:
    """Drop an upper-case dateline with a separator, else one that only a space ends."""
    head = rf"\A\s*[{_UP}]{{2,}}(?:[,\s/&'\-]+[{_UP}0-9]+)*(?:\s*\([A-Za-z0-9\s]+\))?"
    sep, space = head + r"\s*[-—–:]\s+", head + rf"\s+(?=[{_UP}](?:[{_LOW}]|(?U:\b)))"
    return strip(let(x, lambda t: F.regexp_replace(t, F.when(t.rlike(sep), sep).otherwise(space), F.lit(""))))


#: Layout rests in the order in which they go, as (pattern, replacement), here and in the lists below.
_INNER_HEADER = (r"\n\n[^\n]{2,45}(?<![.!?])\n\n", "\n\n")
BASE_STEPS = [
    (r"(?isu)Bekijk de oorspronkelijke pagina:\s*pagina\s*\d+.*\z", ""),
    (r"Link naar PDF", ""),
    (r"\n\nPDF-bestand van dit document\n\n", ""),
    (r"PDF-bestand van dit document\n\n", ""),
    (r"(?isu)\n\n(?:FICTIE|NON-FICTIE|KLASSIEK|LITERATUUR|FILM)\n\n.*\z", ""),
    (r"(?md)\n\n[^\n]+;\s*\d+\s*pagina's;\s*€.*$", ""),
    (r"(?idu)Graphic\n\n.*?(?=\n\n|\n?\z)", ""),
    (r"\A(?:[^\n]{2,100}(?<![.!?])\n\n)+", ""),
    (r"(?iu)\d+x\s+[^\n]+(?=\n\n)", ""),
    _INNER_HEADER,
    (r"(?s)\n\n[^\n]+\n\n[^\n]+\n\n(?:â˜…|â˜†|[★☆\d/])+\n\n.*\z", ""),
]
_AFTER_CAPS = [(r"(?iu)\A[a-zÁÉÓÚÝŇáéóúýň]+/[a-zÁÉÓÚÝŇáéóúýň]+(?:\s*[-–—]\s*)?", ""), (r"\n{3,}", "\n\n")]
TABLOID_STEPS = [
    (r"(?iu)\A(?:VROUW|VRIJ|STRIKTVRIJ|GLAMOUR|REIZEN|CULTUUR|SPORT|GELD)(?:\s+[A-Z\s]+)?\n\n", ""),
    (r"(?:\A|\n\n)[A-Z]{3}(?:/[A-Z]{3}){1,3}\.?\s+", "\n\n"),
    (r"(?iu)of\s+download\s+de\s+gratis\s+Telegraaf-app\s+voor\s+het\s+laatste\s+nieuws\.?", ""),
    (r"(?iu)Bekijk\s+de\s+video\s+(?:bovenaan|onderaan)\s+deze\s+pagina\.?", ""),
    (r"(?iu)Luister\s+hier\s+naar\s+de\s+podcast\.?", ""),
    (r"(?iU)\bdoor\s+\w+\s+\w+", ""),
    (r"(?U)(\w+)\s*:\s*(?=[„'\"“])", "$1, "),
    (r"(?mU)^[ \t]*[-–—][-–— \t]*(?=\w)", ""),
    (r"\s+-(?:\s|\z)", " "),
    (r"(?U)\s+", " "),
]
_ED_STEPS = [
    (r"\A[A-ZÁÉÓÚÝŇ\s]{3,30}\s*[,-]\s*(?:\d{2}\.\d{2}\s*uur\s*-\s*)?", ""),
    (r"(?iu)\n\s*Lees\s+verder\s+onder\s+de\s+(?:video|foto)\s*\n", "\n"),
    _INNER_HEADER,
]
_COLLAPSE = [(r"\n{3,}", "\n\n")]
_SHORT_START = r"\A[a-zà-ÿ][^\n]{0,38}\n\n"
_FROM_START = r"(?idu)\AUit het\s+.*?\n\n"


def fold(x: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, x)


def clean_base(x: Column | str) -> Column:
    """Layout rests out of a body, in a fixed order; empty for null."""
    x = strip_cap_start(fold(F.coalesce(c(x), F.lit("")), BASE_STEPS))
    return normalize_quotes(strip(fold(x, _AFTER_CAPS)))


def clean_tabloid(x: Column | str) -> Column:
    return strip(fold(strip_place(strip(fold(clean_base(x), TABLOID_STEPS))), _COLLAPSE))


def _without_author(x: Column, authors: Column, pattern: str) -> Column:
    """Each author's name taken literally inside the pattern's {}."""
    head, tail = pattern.split("{}")
    names = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a != "")
    quoted = lambda a: F.concat(F.lit(head + "\\Q"), F.replace(a, F.lit("\\E"), F.lit("")), F.lit("\\E" + tail))
    return F.aggregate(names, x, lambda t, a: F.regexp_replace(t, quoted(a), F.lit("")))


def clean_ed(x: Column | str, authors: Column | str) -> Column:
    x = fold(clean_base(x), _ED_STEPS)
    return strip(fold(_without_author(x, c(authors), r"(?iu)\n\n{}\s*\z"), _COLLAPSE))


def clean_dvhn(x: Column | str, authors: Column | str) -> Column:
    x = _without_author(clean_base(x), c(authors), r"(?iu)\A{}\s*\n\n")
    x = F.regexp_replace(strip_place(x), _SHORT_START, "")
    return strip(fold(x, _COLLAPSE))


def clean_stc(x: Column | str) -> Column:
    return strip(fold(strip_place(clean_base(x)), _COLLAPSE))


def clean_nof(x: Column | str) -> Column:
    x = F.regexp_replace(clean_base(x), _FROM_START, "")
    return strip(fold(strip_place(x), _COLLAPSE))


def clean_articles(df: DataFrame) -> DataFrame:
    """Authors, dates, bodies and highlights cleaned by the rules of each row's source."""
    df = df.withColumn("author", clean_author("author")).withColumn("date", format_date_nl("date"))

    def routed(name: str) -> Column:
        s = F.col("source")
        return (
            F.when(s == "Eindhovens Dagblad", clean_ed(name, "author"))
            .when(s == "de Telegraaf", clean_tabloid(name))
            .when(s == "Dagblad van het Noorden", clean_dvhn(name, "author"))
            .when(s == "Steenwijker Courant", clean_stc(name))
            .when(s == "Nieuwsblad Noordoost-Friesland", clean_nof(name))
            .otherwise(clean_base(name))
        )

    return df.withColumns({"full_text": routed("full_text"), "highlight": routed("highlight")})
