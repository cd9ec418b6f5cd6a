"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and letters of the national identity number.
NRIC_WEIGHTS = [2, 7, 6, 5, 4, 3, 2]
NRIC_LETTERS = {"ST": "JZIHGFEDCBA", "FG": "XWUTRQPNMLK"}


def digits(value: Column) -> Column:
    """Only the digits of a text."""
    return F.regexp_replace(value, r"[^0-9]", "")


def nric_letter(compact: Column) -> Column:
    """The check letter of a prefix S, T, F or G and seven digits: their weighted sum (plus 4 for T and G) names it."""
    figures = [F.when(compact.rlike("^[STFG][0-9]{7}"), F.substring(compact, i + 2, 1).cast("int")) for i in range(7)]
    total = sum((d * w for d, w in zip(figures, NRIC_WEIGHTS, strict=True)), F.when(compact.rlike("^[TG]"), 4).otherwise(0))
    letters = F.when(compact.rlike("^[ST]"), NRIC_LETTERS["ST"]).otherwise(NRIC_LETTERS["FG"])
    return letters.substr(total % 11 + 1, F.lit(1))


def nric_valid(value: Column) -> Column:
    """Prefix, seven digits and the right check letter; spaces and hyphens don't count."""
    compact = F.upper(F.regexp_replace(value, r"[ -]", ""))
    return compact.rlike(r"^[STFG][0-9]{7}[A-Z]$") & (F.substring(compact, 9, 1) == nric_letter(compact))


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits with a Luhn check digit; separators don't count."""
    return F.length(digits(value)).between(13, 19) & F.call_function("luhn_check", digits(value))


def _mod97(compact: Column) -> Column:
    """The remainder of a rearranged IBAN, letters as two digits, folded character by character."""
    start = F.lit(0).cast("long")
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(compact, ""), start, lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97))


def iban_valid(value: Column) -> Column:
    """Two letters, two digits, 11 to 30 letters or digits, and the remainder 1 by 97."""
    compact = F.upper(F.regexp_replace(value, r"\s", ""))
    shaped = compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return F.when(shaped, _mod97(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))) == 1).otherwise(False)


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of a country code and the rest of an IBAN."""
    return F.lpad((98 - _mod97(F.concat(F.upper(rest), F.upper(country), F.lit("00")))).cast("string"), 2, "0")
