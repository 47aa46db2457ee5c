"""Redaction of personal identifiers in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.contract import RUN_MARK, UUID_MARK

# A word character here is any letter, any number or '_' of any script.
_START = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"
# The two identifier layouts.
_UUID = "[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
_RUN = r"\p{Nd}{1,3}(?:\.\p{Nd}{3}){2}-[\p{Nd}kK]"
# The look ahead rules out most positions before the character behind is examined.
UUID_IN_TEXT = rf"(?=[0-9a-fA-F]{{8}}-){_START}{_UUID}{_END}"
RUN_IN_TEXT = rf"(?=\p{{Nd}}{{1,3}}\.){_START}{_RUN}{_END}"


def redact(text: Column) -> Column:
    """Replace hyphenated UUIDs and dotted RUN numbers by fixed marks."""
    without_uuid = F.regexp_replace(text, UUID_IN_TEXT, UUID_MARK)
    return F.regexp_replace(without_uuid, RUN_IN_TEXT, RUN_MARK)
