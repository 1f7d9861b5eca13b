"""Names, numbers and dates as text: Column expressions shared by all plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.functions.keys import stripped

#: Spanish month abbreviations of the daily series; September is written two ways. Fixed values.
MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "sep": 9, "oct": 10, "nov": 11, "dic": 12}
PIVOT = 90
ACCENTED, UNACCENTED = "ÁÉÍÓÚÜÑ", "AEIOUUN"


def company_name(c: Column) -> Column:
    """Upper case without Spanish accents, punctuation as blanks, blanks collapsed; blank names are NULL."""
    t = F.translate(F.upper(c), ACCENTED, UNACCENTED)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(t, "[^A-Z0-9]", " "), " +", " ")), F.lit(""))


def loose_name(c: Column) -> Column:
    """The exploratory variant: accented letters become blanks."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", " "), " +", " ")), F.lit(""))


def series_date(c: Column) -> Column:
    """The day of a line of a series: ``02Ene97``, ``2 Ene. 1997``, ``02/01/1997``, ``02-01-97``, ``19970102`` or ``1997-01-02``
    (a time after it does not count). The day stands before the month; two-digit years from 90 on are 19xx. NULL for anything else."""
    t = F.lower(stripped(c))
    month = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def read(pattern: str, named: bool = False, year_first: bool = False) -> Column:
        part = [F.regexp_extract(t, pattern, i) for i in (1, 2, 3)]
        y, m, d = part if year_first else part[::-1]
        m = F.try_element_at(month, m).cast("string") if named else m
        n = y.try_cast("int")
        year = F.when(F.length(y) > 2, n).when(n >= PIVOT, 1900 + n).otherwise(2000 + n)
        text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.to_date(F.try_to_timestamp(F.when((part[0] != "") & m.isNotNull(), text), F.lit("yyyy-MM-dd")))

    return F.coalesce(
        read(r"^(\d{1,2})[ .-]?([a-z]{3})[ .-]?(\d{4}|\d{2})$", named=True), read(r"^(\d{2})[/-](\d{2})[/-](\d{4}|\d{2})$"),
        read(r"^(\d{4})(\d{2})(\d{2})$", year_first=True), read(r"^(\d{4})-(\d{2})-(\d{2})(?:t.*)?$", year_first=True),
    )


def day(c: Column) -> Column:
    """``dd/MM/yyyy`` or ``yyyy-MM-dd`` at the start of a text; NULL for anything else."""
    t = F.substring(F.trim(c), 1, 10)
    return F.coalesce(F.to_date(F.try_to_timestamp(t, F.lit("dd/MM/yyyy"))), F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))


def half_day_time(c: Column) -> Column:
    """``dd/MM/yyyy hh:mm:ss a. m.`` with or without blanks and points, as a timestamp."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s*a\.?\s*m\.?$", " AM"), r"\s*p\.?\s*m\.?$", " PM")
    return F.try_to_timestamp(t, F.lit("dd/MM/yyyy hh:mm:ss a"))


def series_number(c: Column, comma: str = "decimal") -> Column:
    """A number of a series; ``n.d.`` and blanks are NULL. ``comma``: "decimal" (3,75 is 3.75) or "thousands" (375)."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("n.d.", ""), F.regexp_replace(t, ",", "." if comma == "decimal" else "")).try_cast("double")


def quarter_label(number: Column) -> Column:
    """``1er Trimestre`` to ``4to Trimestre``; NULL for anything else."""
    return F.when(number == 1, "1er Trimestre").when(number == 2, "2do Trimestre").when(number == 3, "3er Trimestre").when(number == 4, "4to Trimestre")


def percent_change(new: Column, old: Column) -> Column:
    """100 * (new - old) / old where old is positive, else NULL."""
    return F.when(old > 0, 100 * (new - old) / old)


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """100 * part / whole, rounded; NULL where the whole is 0."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def payload_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON that keeps NULLs; equal rows have equal hashes whatever their order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


#: What stands for NULL in a hashed key. Fixed value.
NULL_MARK = "<NULL>"


def key_hash(*columns: Column) -> Column:
    """SHA-256 of the columns joined by ``||``; a NULL counts as NULL_MARK, so it is not the same as an empty text."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in columns)), 256)
