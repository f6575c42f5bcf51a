"""Token counts."""

from pyspark.sql import Column, functions as F

from scriptmill.functions.chars import WORD, WS, column

TOKEN = rf"[{WORD}]+|[^{WORD}{WS}]"


def token_count(text) -> Column:
    """Words and single symbols. Every operator that counts takes another Column in its place."""
    return F.size(F.regexp_extract_all(column(text), F.lit(TOKEN), F.lit(0))).cast("bigint")
