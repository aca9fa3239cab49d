"""Numbered protection of what must not be translated."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from qirtas.functions.text import PROTECTED

PATTERNS = [re.compile(p) for p in PROTECTED]
# The marks, which no text holds and no number pattern reads.
MARK = re.compile("\x00T(\\d+)\x00")


def protect_one(text: str) -> tuple[str, list[str]]:
    """(masked text, protected tokens) by each pattern in turn; equal tokens share a mark, numbered at first sight."""
    seen: dict[str, int] = {}
    for pattern in PATTERNS:
        text = pattern.sub(lambda m: f"\x00T{seen.setdefault(m[0], len(seen))}\x00", text)
    return text, list(seen)


def restore_one(text: str, tokens: list[str]) -> str:
    """Marks become their tokens again; unknown marks vanish."""
    return MARK.sub(lambda m: tokens[int(m[1])] if int(m[1]) < len(tokens) else "", text)


@F.pandas_udf(StructType([StructField("masked", StringType()), StructField("tokens", ArrayType(StringType()))]))
def protect(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([protect_one(t) if t is not None else (None, None) for t in texts], columns=["masked", "tokens"])


@F.pandas_udf(StringType())
def restore(texts: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([restore_one(t, list(k)) if t is not None else None for t, k in zip(texts, tokens, strict=True)], dtype=object)
