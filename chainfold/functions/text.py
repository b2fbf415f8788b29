"""Text forms: fixed-point amounts, addresses, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import u256

#: A 256-bit number has no more digits than this and one.
MOST_DECIMALS = 77


def amount_text(digits: Column, decimals: Column | int) -> Column:
    """Digits of a whole number as a fixed-point text without trailing zeros or dot."""
    d = F.least(F.lit(decimals) if isinstance(decimals, int) else decimals, F.lit(MOST_DECIMALS)).cast("int")
    padded = F.call_function("lpad", digits, F.greatest(F.char_length(digits), d + 1), F.lit("0"))
    whole = F.call_function("left", padded, F.char_length(padded) - d)
    part = F.rtrim(F.call_function("right", padded, d), F.lit("0"))
    return F.when((d == 0) | (part == ""), whole).otherwise(F.concat(whole, F.lit("."), part))


def word_amount(word: Column, decimals: Column | int) -> Column:
    return amount_text(u256.to_text(word), decimals)


def hex_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def parse_address(text: Column) -> Column:
    """40 hex digits with or without 0x to bytes, null for anything else."""
    digits = F.regexp_extract(text, "^(?:0x)?([0-9a-fA-F]{40})$", 1)
    return F.when(digits != "", F.unhex(digits))


def concat_key(*parts: Column) -> Column:
    return F.concat(*parts)
