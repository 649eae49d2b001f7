"""Checksum validation of Italian identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.operators.rules import FISCAL_CODE, IBAN

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The weight of each character of ALPHABET at odd places of a fiscal code.
ODD_WEIGHTS = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
#: At even places a digit weighs its value and a letter its place in the alphabet.
EVEN_WEIGHTS = tuple(range(10)) + tuple(range(26))


def _chars(value: Column) -> Column:
    """The single characters of an ASCII string."""
    return F.split(value, "")


def _total(chars: Column, weigh) -> Column:
    """The sum of ``weigh(character, place)`` over characters, places from 0."""
    return F.aggregate(F.transform(chars, lambda c, i: weigh(c, i)), F.lit(0), lambda a, x: a + x)


def valid_fiscal_code(value: Column) -> Column:
    """True if the last letter is that of the weights' sum modulo 26; false for any other shape, null for null."""
    code = F.upper(F.trim(value))
    odd, even = F.array(*map(F.lit, ODD_WEIGHTS)), F.array(*map(F.lit, EVEN_WEIGHTS))

    def weigh(c: Column, i: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c) - 1
        return F.when(i % 2 == 0, F.get(odd, at)).otherwise(F.get(even, at))

    total = _total(_chars(F.substring(code, 1, 15)), weigh)
    return F.when(code.rlike(f"^(?:{FISCAL_CODE})$"), F.char(total % 26 + 65) == F.substring(code, 16, 1)).when(value.isNotNull(), F.lit(False))


def valid_vat_number(value: Column) -> Column:
    """True for 11 digits whose doubled-digit sum ends in the check digit; non-digits are ignored."""
    digits = F.regexp_replace(value, r"(?U)\D", "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = _total(_chars(F.substring(digits, 1, 10)), weigh)
    return F.when(digits.rlike("^[0-9]{11}$"), (10 - total % 10) % 10 == F.substring(digits, 11, 1).cast("int")).when(value.isNotNull(), F.lit(False))


def valid_iban(value: Column) -> Column:
    """True for an Italian IBAN whose rearranged number is 1 modulo 97; white space is ignored."""
    plain = F.upper(F.regexp_replace(value, r"(?U)\s+", ""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        d = F.instr(F.lit(ALPHABET), c) - 1
        return (acc * F.when(d > 9, 100).otherwise(10) + d) % 97

    return F.when(plain.rlike(f"^(?:{IBAN})$"), F.aggregate(_chars(turned), F.lit(0), step) == 1).when(value.isNotNull(), F.lit(False))
