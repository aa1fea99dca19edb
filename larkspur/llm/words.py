"""Words of a text, apart from case, punctuation, spacing, markup and the way characters are encoded."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

#: Tags that don't end a word: they are taken out, all other tags become a space. Fixed values.
INLINE = "a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var"
_INLINE = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<!--.*?-->", re.DOTALL)
#: Soft hyphens, joiners, direction marks, word joiners and combining marks carry no letter of their own.
_INVISIBLE = re.compile("[­͏​-‏‪-‮⁠-⁤︀-️﻿̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")
_EMPHASIS = re.compile(r"[*_~`]+")


def words_of(text: str | None) -> list[str]:
    """The words of one text in order; null and empty texts have none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    if "*" in text or "_" in text or "~" in text or "`" in text:
        text = _EMPHASIS.sub("", text)
    return _WORD.findall(text.casefold())


def portions(pdf: pd.DataFrame, column: str = "text", chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """An Arrow batch in parts of about so many characters, so that long texts don't fill a worker's memory."""
    part = pdf[column].str.len().fillna(0).cumsum().floordiv(chars)
    for _, rows in pdf.groupby(part, sort=False):
        yield rows


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(text: pd.Series) -> pd.Series:
    return text.map(words_of)
