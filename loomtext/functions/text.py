"""Column expressions over text.  All are built-in Catalyst expressions and stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word (``\w``), as a Java pattern.
WORD = r"(?U)\w+"
QUOTED = '"([^"]*)"|“([^”]*)”'

#: Dutch month names.
MONTHS_NL = {
    "januari": "01", "februari": "02", "maart": "03", "april": "04", "mei": "05", "juni": "06",
    "juli": "07", "augustus": "08", "september": "09", "oktober": "10", "november": "11", "december": "12",
}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: a lambda's variable keeps plans of reused expressions small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def word_count(x: Column | str) -> Column:
    """Words between white space; 0 for null."""
    return F.regexp_count(F.coalesce(c(x), F.lit("")), F.lit(r"\S+"))


def unicode_words(x: Column | str) -> Column:
    """Runs of letters, digits, marks and underscores; 0 for null."""
    return F.regexp_count(F.coalesce(c(x), F.lit("")), F.lit(WORD))


def text_scope(scope: str = "all", title: str = "title", highlight: str = "highlight", body: str = "full_text") -> Column:
    """Non-blank parts of a record joined by one space.  Scopes: all, title_only, highlight_only, body_only; any other
    is all."""
    parts = {"title_only": [title], "highlight_only": [highlight], "body_only": [body]}.get(scope, [title, highlight, body])
    return F.concat_ws(" ", *[F.when(F.trim(F.col(p)) != "", F.trim(F.col(p))) for p in parts])


def normalize_quotes(x: Column | str) -> Column:
    """Low, curly and doubled quotes to ASCII ones; doubled commas first, doubled marks last."""
    x = F.replace(c(x), F.lit(",,"), F.lit('"'))
    x = F.translate(x, "„“”«»＂‘’‚‛", '""""""' + "''''")
    x = F.replace(x, F.lit("''"), F.lit('"'))
    return F.replace(x, F.lit("``"), F.lit('"'))


def normalize_text(x: Column | str) -> Column:
    """Line ends to \\n, three and more to two, lines right-stripped, the whole stripped."""
    x = F.regexp_replace(c(x), "\r\n|[\r  \u0085]", "\n")
    x = F.regexp_replace(x, r"(?m)[ \t\f\x0B]+$", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def format_date_nl(x: Column | str) -> Column:
    """'3 mei 2024' inside a text as DD/MM/YYYY; unknown months are 01; without a date the text stays."""
    x = c(x)
    p = r"(?i)(\d{1,2})\s+([a-z]+)\s+(\d{4})"
    months = F.create_map(*[F.lit(v) for kv in MONTHS_NL.items() for v in kv])
    month = F.coalesce(F.try_element_at(months, F.lower(F.regexp_extract(x, p, 2))), F.lit("01"))
    date = F.concat_ws("/", F.lpad(F.regexp_extract(x, p, 1), 2, "0"), month, F.regexp_extract(x, p, 3))
    return F.when(x.rlike(p), date).otherwise(x)


def parse_date(x: Column | str) -> Column:
    """D/M/YYYY as a date; null if it is none."""
    return F.try_to_date(F.trim(c(x)), "d/M/yyyy")


def year_month(x: Column | str) -> Column:
    return F.date_format(parse_date(x), "yyyy-MM")


def quarter_label(d: Column | str) -> Column:
    return F.concat(F.year(c(d)).cast("string"), F.lit("-Q"), F.quarter(c(d)).cast("string"))


def quarter_number(d: Column | str) -> Column:
    return F.year(c(d)) + (F.quarter(c(d)) - 1) / F.lit(4.0)


def quarter_period(d: Column | str, split: float = 2023.0) -> Column:
    year, q = int(split), int((split % 1) * 4) + 1
    name = f"{year}-Q{q}"
    return F.when(quarter_number(d) < split, f"before_{name}").otherwise(f"{name}_and_after")


def text_features(x: Column | str) -> dict[str, Column]:
    """Word, dash, quote and quoted-word counts, with rates that are null without words."""
    x = F.coalesce(c(x), F.lit(""))
    words = unicode_words(x)
    spans = F.regexp_extract_all(x, F.lit(QUOTED), F.lit(0))
    dashes = F.regexp_count(x, F.lit("—| - "))
    quoted = F.aggregate(spans, F.lit(0), lambda a, s: a + F.regexp_count(s, F.lit(WORD)))
    n = F.nullif(words, F.lit(0))
    return {
        "total_words": words,
        "em_dash_count": dashes,
        "quote_count": F.size(spans),
        "quote_word_count": quoted,
        "em_dashes_per_1k_words": dashes * 1000.0 / n,
        "quotes_per_1k_words": F.size(spans) * 1000.0 / n,
        "quote_word_fraction": quoted.cast("double") / n,
    }


def contains_any(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def starts_with_any(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [x.startswith(w) for w in words])


def hits(x: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [x.contains(w).cast("int") for w in words])


def first_of(label: str, *tests: tuple[Column, str]) -> Column:
    """The label of the first test that holds, else ``label``."""
    out = F.lit(label)
    for test, name in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out
