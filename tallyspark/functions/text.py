"""Text to typed value. Bad text becomes null, never an error."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points.
WHITE_SPACE = "".join(
    map(
        chr,
        [
            *range(0x0009, 0x000E),
            0x0020,
            0x0085,
            0x00A0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

ASCII_SPACE = "\t\n\v\f\r "

# Every decimal digit (category Nd) beyond ASCII, and its value in the same order.
_DIGITS = [
    char for char in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(char) == "Nd"
]
_DIGIT_VALUES = "".join(str(unicodedata.decimal(char)) for char in _DIGITS)

INTEGER = r"^[+-]?\d+\z"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def strip(text: Column) -> Column:
    """Drop Unicode white space on both ends (``trim`` alone only knows the ASCII space).

    Pure ASCII text, where characters and bytes are equally many, is compared with
    the six ASCII ones only, which takes half the time.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.btrim(text, F.lit(ASCII_SPACE))).otherwise(
        F.btrim(text, F.lit(WHITE_SPACE))
    )


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as ``0`` to ``9``; other characters stay."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(
        F.translate(text, "".join(_DIGITS), _DIGIT_VALUES)
    )


def null_if_token(text: Column, tokens: tuple[str, ...]) -> Column:
    return F.when(~text.isin(*tokens), text)


# The pattern guards are needed: a cast alone also accepts control characters
# around a number and Java suffixes such as '1d', and completes '1990-1-5'.


def to_long(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def to_double(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def to_date(text: Column) -> Column:
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def is_finite(number: Column) -> Column:
    """Null stays null; NaN sorts above infinity in Spark, so one comparison covers it."""
    return F.abs(number) < F.lit(float("inf"))
