"""Column expressions that the operators share."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F

#: Edition words that a release title loses.
EDITION_WORDS = r"deluxe|expanded|remaster(?:ed)?|anniversary|edition|bonus|explicit|clean"
BARE_EDITION = r"\d{2,4}(?:st|nd|rd|th)? anniversary|deluxe|expanded|remaster(?:ed)?|edition|bonus tracks?|explicit|clean"
#: Words in brackets that a title loses when catalogs of two sources are compared.
CORROBORATION_WORDS = r"deluxe|expanded|remaster(?:ed)?|anniversary|edition|bonus"
GENERIC_TITLES = ("album", "best of", "greatest hits", "live", "remixes", "the album")


@cache
def _udf(form: str, marks: bool):
    """An Arrow UDF for a Unicode normal form; made when first used, as it needs a session."""

    def run(x: pd.Series) -> pd.Series:
        out = x.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")
        return out if marks else out.map(lambda v: "".join(c for c in v if not "\u0300" <= c <= "\u036f"), na_action="ignore")

    return F.pandas_udf(run, "string")


def _nfkc(x: Column) -> Column:
    return _udf("NFKC", True)(x)


def _unmarked(x: Column) -> Column:
    return _udf("NFKD", False)(x)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    x = F.trim(_col(x))
    return F.when(x != "", x)


def name_key(x, unicode: bool = True) -> Column:
    """Names compare equal by this: blanks collapsed, lower case; NFKC by an Arrow UDF where a name isn't ASCII."""
    x = _col(x)
    if unicode:
        x = F.when(x.rlike(r"[^\x00-\x7F]"), _nfkc(x)).otherwise(x)
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def title_key(x, unicode: bool = True) -> Column:
    """Release titles compare equal by this: no marks, no edition words, letters and digits alone."""
    x = F.coalesce(_col(x), F.lit(""))
    if unicode:
        x = F.when(x.rlike(r"[^\x00-\x7F]"), _unmarked(x)).otherwise(x)
    x = F.regexp_replace(F.lower(x), rf"[\[(].*?\b({EDITION_WORDS})\b.*?[\])]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, rf"\b({BARE_EDITION})\b", ""), "[^a-z0-9]+", " "))


@cache
def _unmarked_all():
    """As _unmarked, for each string of an array."""

    def run(x: pd.Series) -> pd.Series:
        plain = lambda v: v if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not "\u0300" <= c <= "\u036f")
        return x.map(lambda values: [plain(v) for v in values], na_action="ignore")

    return F.pandas_udf(run, "array<string>")


def corroboration_keys(titles) -> Column:
    """Distinct keys by which titles of two sources compare: no marks, no bracketed edition words; generic titles aside."""
    titles = _col(titles)
    plain = F.when(F.exists(titles, lambda t: t.rlike(r"[^\x00-\x7F]")), _unmarked_all()(titles)).otherwise(titles)
    key = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), rf"[\[(].*?\b({CORROBORATION_WORDS})\b.*?[\])]", ""),
        "[^a-z0-9]+", " "))
    return F.array_except(F.array_distinct(F.transform(plain, key)), F.array(F.lit(""), *map(F.lit, GENERIC_TITLES)))


def slug(x) -> Column:
    x = _col(x)
    x = F.when(x.rlike(r"[^\x00-\x7F]"), _unmarked(x)).otherwise(x)
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def partial_date(value, precision=None) -> Column:
    """struct(value, precision, start, end) of a date known to its year, month or day; null where it isn't one.

    A value that the calendar doesn't have (month 13) is null.
    """
    v = blank_to_null(value)
    given = _col(precision) if precision is not None else F.lit(None).cast("string")
    guessed = F.when(v.rlike("^[0-9]{4}$"), "year").when(v.rlike("^[0-9]{4}-[0-9]{1,2}$"), "month").otherwise("day")
    kind = F.when(given.isin("year", "month", "day"), given).otherwise(guessed)
    text = F.when(kind == "year", F.concat(F.substring(v, 1, 4), F.lit("-01-01"))).when(kind == "month",
        F.concat(F.substring(v, 1, 7), F.lit("-01"))).otherwise(F.substring(v, 1, 10))
    start = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    after = F.when(kind == "year", F.add_months(start, 12)).when(kind == "month", F.add_months(start, 1)).otherwise(F.date_add(start, 1))
    end = (after.cast("timestamp") - F.expr("interval 1 millisecond")).alias("end")
    return F.when(start.isNotNull(), F.struct(v.alias("value"), kind.alias("precision"), start.cast("timestamp").alias("start"), end))


def id_from_url(x, pattern: str) -> Column:
    """Group 1 of a pattern, null where it isn't found."""
    found = F.regexp_extract(_col(x), pattern, 1)
    return F.when(found != "", found)


def content_id(*columns: str) -> Column:
    """sha256 of the columns as JSON in alphabetical order, nulls included."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def entity_key(provider, kind, id_) -> Column:
    return F.concat_ws(":", _col(provider), _col(kind), _col(id_))


def int_with_commas(x) -> Column:
    x = F.regexp_replace(F.trim(_col(x)), ",", "")
    return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("long"))


def html_text(x) -> Column:
    """Text of an HTML fragment: tags dropped, entities decoded, blanks collapsed."""
    x = F.regexp_replace(_col(x), "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clamp_round(x, low: int = 0, high: int = 100) -> Column:
    """Half-up rounding within bounds."""
    return F.least(F.greatest(F.floor(_col(x) + 0.5), F.lit(low)), F.lit(high)).cast("long")


def reasons(*pairs) -> Column:
    """Array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)))
