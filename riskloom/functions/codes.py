"""Column functions for coded text, dates and risk factors."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "AUSENTE"
# Lower ends of the age bands and their names; coarse bands; fill patterns and the limit of blank answers; white space; words for nothing
BANDS = ((0, "<1"), (1, "1-4"), (5, "5-11"), (12, "12-17"), (18, "18-39"), (40, "40-59"), (60, "60-79"), (80, "80+"))
COARSE = {"menos de 5 anos": ("<1", "1-4"), "5 a 17 anos": ("5-11", "12-17"), "18 a 59 anos": ("18-39", "40-59"), "60 anos ou mais": ("60-79", "80+")}
BLANK_LIMIT = 6
PATTERNS = ("comorbidades_sem_nao", "sim_e_nao", "sintomas_em_branco")
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NULL_WORDS = ("", "nan", "none", "null", "<na>", "nat")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def code(c: Column) -> Column:
    """Text without margins and a trailing ``.0``; words for nothing become null."""
    bare = F.regexp_replace(stripped(c), r"\.0$", "")
    digit = (F.octet_length(c) == 1) & c.between("0", "9")  # most codes: nothing to strip
    return F.when(digit, c).when(~F.lower(bare).isin(*NULL_WORDS), bare)


def iso_date(c: Column) -> Column:
    plain = c.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z")  # most dates: no format is needed
    return F.when(plain, c.try_cast("date")).otherwise(F.to_date(F.try_to_timestamp(stripped(c), F.lit("yyyy-M-d"))))


def tolerant_date(c: Column) -> Column:
    """ISO, else day/month/year."""
    return F.coalesce(iso_date(c), F.to_date(F.try_to_timestamp(stripped(c), F.lit("d/M/yyyy"))))


def number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), stripped(c).try_cast("double"))


def years_of(v: Column, u: Column) -> Column:
    """Years from a number and a unit that are columns already; ``lifetime`` bounds them."""
    return F.when(u == "1", v / 365.25).when(u == "2", v / 12).when(u == "3", v)


def lifetime(years: Column) -> Column:
    return F.when(years.between(0, 120), years)


def age_years(value: Column, unit: Column) -> Column:
    """Years from a value in days (unit 1), months (2) or years (3); outside 0 to 120 null."""
    return lifetime(years_of(number(value), code(unit)))


def age_band(years: Column) -> Column:
    out = F.when(years.isNull(), "desconhecida")
    for low, name in reversed(BANDS):
        out = out.when(years >= low, name)
    return out.otherwise("desconhecida")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def interval_flags(days: Column, most: int) -> tuple[Column, Column]:
    """(invalid, negative) as 0 or 1; a missing interval is invalid and not negative."""
    bad = F.coalesce((days < 0) | (days > most), F.lit(True))
    return bad.cast("byte"), F.coalesce(days < 0, F.lit(False)).cast("byte")


def season(day: Column, period: float = 52.18) -> tuple[Column, Column]:
    turn = F.weekofyear(day) * F.lit(2 * math.pi / period)
    return F.sin(turn), F.cos(turn)


def sex(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.isin("M", "F", "I"), s).otherwise("outro")


def fill_when_parent_denies(c: Column, parent: Column) -> Column:
    """A blank answer below a question that was answered no becomes no."""
    return F.when(F.coalesce(code(parent) == "2", F.lit(False)) & code(c).isNull(), "2").otherwise(c)  # the parent first: few deny


def group_id(number_: Column, record: Column) -> Column:
    """The notification number without white space, else the record's own id; an error when both say nothing."""
    bare, own = F.regexp_replace(number_, r"(?U)\s+", ""), stripped(record)
    says = lambda c: F.coalesce(~F.lower(c).isin(*NULL_WORDS), F.lit(False))
    plain = number_.try_cast("long").cast("string") == number_  # most numbers: no white space
    return F.when(plain, number_).when(says(bare), bare).when(says(own), F.concat(F.lit("sem_notific:"), own)).otherwise(F.raise_error(F.lit("neither notification number nor record id")).cast("string"))


def target(c: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    v = code(c)
    return F.when(v.isin(*positive), 1).when(v.isin(*negative), 0).cast("byte")


def period(year: Column, sealed: tuple[int, ...], shared: tuple[int, ...]) -> Column:
    return F.when(year.isNull(), "ano_ausente").when(year.isin(*sealed), "pandemico").when(year.isin(*shared), "compartilhado").otherwise("exploracao")


def _single(c: Column) -> Column:
    return F.octet_length(c) == 1  # most answers: no margins to strip


def answered(c: Column) -> Column:
    return F.coalesce(F.when(_single(c), c.isin("1", "2")).otherwise(stripped(c).isin("1", "2")), F.lit(False)).cast("int")


def _blank(c: Column) -> Column:
    return F.when(c.isin("1", "2", "9"), 0).otherwise((F.coalesce(stripped(c), F.lit("")) == "").cast("int"))


def completeness(columns: list[Column]) -> Column:
    """Percent of columns answered yes or no, rounded as Spark rounds doubles; there is a value for each number of answers."""
    percent = lambda n: float(Decimal(repr(100.0 * n / len(columns))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    return F.get(F.array(*(F.lit(percent(n)) for n in range(len(columns) + 1))), reduce(Column.__add__, map(answered, columns)))


def any_answer(columns: list[Column]) -> Column:
    return reduce(Column.__add__, map(answered, columns)) > 0


def fill_pattern(secondary: list[Column], conditions: list[Column]) -> Column:
    """How a record was filled: secondary symptoms left blank, conditions without a single no, or both answers."""
    denied = reduce(Column.__or__, (F.coalesce(F.when(_single(c), c == "2").otherwise(stripped(c) == "2"), F.lit(False)) for c in conditions))
    blank = reduce(Column.__add__, map(_blank, secondary))
    return F.when(blank >= BLANK_LIMIT, PATTERNS[2]).when(~denied, PATTERNS[0]).otherwise(PATTERNS[1])


def coarse_band(band: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, bands in COARSE.items():
        out = F.when(band.isin(*bands), name).otherwise(out)
    return out


def label(*parts: Column) -> Column:
    """A composite stratum, its parts separated by bars; null where a part is."""
    whole = reduce(Column.__and__, (p.isNotNull() for p in parts))
    return F.when(whole, F.concat_ws("|", *parts))


def label_part(c: Column, i: int) -> Column:
    return F.get(F.split(c, r"\|"), F.lit(i))


def kept_interval(days: Column, most: int, policy: str = "sinalizar") -> Column:
    """Which rows an interval lets stay: all of them (``sinalizar``), or those with a valid one (``descartar``)."""
    if policy not in ("sinalizar", "descartar"):
        raise ValueError(f"unknown policy: {policy}")
    return F.lit(True) if policy == "sinalizar" else interval_flags(days, most)[0] == 0
