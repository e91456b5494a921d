"""Similarity of two texts by their word lists."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = re.compile(r"[0-9A-Za-z가-힣]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def similarity(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio over lower-case words; 0 where either has none."""
    x, y = words_of(a), words_of(b)
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def token_similarity(a: Column, b: Column) -> Column:
    """``similarity`` in Arrow batches, null where ``a`` is; a text's words are made once in a batch."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        words: dict[str, list[str]] = {}
        matcher, second = SequenceMatcher(None), None

        def of(text: str) -> list[str]:
            if text not in words:
                words[text] = words_of(text)
            return words[text]

        def one(p: str | None, q: str | None) -> float | None:
            nonlocal second
            if p is None or q is None:
                return None
            if not of(p) or not of(q):
                return 0.0
            if q != second:
                matcher.set_seq2(of(q))
                second = q
            matcher.set_seq1(of(p))
            return matcher.ratio()

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
