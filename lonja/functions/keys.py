"""Normal forms of the keys that tables are joined by.

All are Column expressions, so they stay inside whole-stage code generation, and all give NULL for NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing value, compared in lower case. Fixed values.
MISSING_MARKERS = ("", "-", "n.d.", "n.d", "nan", "null", "none")

BLANKS = r"^[\s ﻿]+|[\s ﻿]+$"


def stripped(c: Column) -> Column:
    """The text without white space (no-break spaces included) at its ends."""
    return F.regexp_replace(c.cast("string"), BLANKS, "")


def ticker(c: Column) -> Column:
    """A ticker compares trimmed and in upper case; a blank one is NULL."""
    return F.nullif(F.upper(stripped(c)), F.lit(""))


def company_id(c: Column) -> Column:
    """The 11 digits of a company id, or NULL if the text does not hold a valid one.

    Blanks, separators, a leading word and a trailing decimal part made of zeros are left out.
    """
    digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"[.,]0*\s*$", ""), r"[^0-9]", "")
    return F.when((F.length(digits) == 11) & (digits != "0" * 11), digits)


def folded(c: Column) -> Column:
    """Upper case without the accents of Spanish, Portuguese, French, Italian and German."""
    return F.translate(F.upper(c.cast("string")), "ÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝ", "AAAAAAEEEEIIIIOOOOOUUUUNCY")


def quarter(c: Column) -> Column:
    """The number 1 to 4 of a quarter written in digits, Roman numerals or words; NULL if it names none."""
    t = F.regexp_replace(folded(stripped(c)), r"[^A-Z0-9]+", " ")
    digit = F.regexp_extract(t, r"^ ?(?:TRIMESTRE |TRIM |T|Q)? ?0?([1-4])(?:[A-Z ]|$)", 1)
    word = F.regexp_extract(t, r"(?:^| )(IV|III|II|I|PRIMER|SEGUND|TERCER|CUART)(?:[AO]?)(?: |$)", 1)
    return (
        F.when(digit != "", digit.try_cast("int"))
        .when(word.isin("I", "PRIMER"), 1)
        .when(word.isin("II", "SEGUND"), 2)
        .when(word.isin("III", "TERCER"), 3)
        .when(word.isin("IV", "CUART"), 4)
    )


def information_type(c: Column) -> Column:
    """``INDIVIDUAL`` or ``CONSOLIDADA`` for any spelling or abbreviation; other labels in upper case."""
    t = F.nullif(folded(stripped(c)), F.lit(""))
    return F.when(t.rlike(r"^I(?:$|\.|ND)"), "INDIVIDUAL").when(t.rlike(r"^C(?:$|\.|ONS)"), "CONSOLIDADA").otherwise(t)


def text_value(c: Column) -> Column:
    """The text, or NULL where it is blank or a marker of a missing value."""
    t = stripped(c)
    return F.when(~F.lower(t).isin(*MISSING_MARKERS), t)


def number_value(c: Column) -> Column:
    """The double, or NULL where it is NaN, infinite or no number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
