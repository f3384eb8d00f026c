"""The few functions that Spark has no expression for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Places in which a full stop does not end a sentence.
PROTECTED = [
    r"\bpp?\.\s*\d",
    r"\b(?:Vol|No|Ch|Fig|Tab|Eds?|Trans|Op|cit|cf|[Ii]bid|Jr|Sr|St|Mr|Mrs|Ms|Dr|Prof|vs|approx)\.",
    r"\bet\s*al\.",
    r"\b(?:U\.S|U\.K|A\.D|B\.C|e\.g|i\.e|Ph\.D|M\.A|B\.A)\.",
    r"\b[A-Z]\.(?=\s*[A-Z])",
    r"\d+\.\d+",
    r"\d{4}\.\s?\d{1,2}\.\s?\d{1,2}\.?",
    r"\d+\.\d+\.\d+",
]


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition of characters; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def decoded(encoding: str):
    """Texts of bytes in an encoding that Spark itself does not read."""

    @F.pandas_udf(StringType())
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b).decode(encoding), na_action="ignore")

    return decode


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, from 0 to 1; null counts as empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def mask_dots(text: pd.Series) -> pd.Series:
    """Full stops in protected places become NUL; the length stays."""
    return text.map(masked, na_action="ignore")


def masked(text: str) -> str:
    spots = {i for p in PROTECTED for m in re.finditer(p, text) for i in range(*m.span()) if text[i] == "."}
    return "".join("\0" if i in spots else c for i, c in enumerate(text)) if spots else text
