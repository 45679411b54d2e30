"""Words of dirty texts, as seen by every operator on texts here."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеіѕјорсухкԁԛԝհոցΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιкмтһ",
    "ABESIJKMHOPCTYXaeisjopcyxkdqwhngABEZHIKMNOPTYXovaikmth",
)
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<[!?][^<>]*>")
_MD_LINK = re.compile(r"\]\([^()\s]+\)")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def strip_comments(text: str) -> str:
    """Text without mark-up comments, in one pass; one that is never closed stays."""
    parts, at = [], 0
    while (i := text.find("<!--", at)) >= 0 and (j := text.find("-->", i + 4)) >= 0:
        parts.append(text[at:i])
        at = j + 3
    return " ".join([*parts, text[at:]])


def strip_tags(text: str) -> str:
    """Text without tags of any length; a ``<`` or ``>`` between words or figures is none."""
    return _TAG.sub(" ", strip_comments(text))


def plain(text: str) -> str:
    """Text without mark-up, invisible and look-alike characters, broken words joined."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = strip_tags(text)
    if "](" in text:
        text = _MD_LINK.sub(" ", text)
    text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
    return text


def strip_marks(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Lower-case words without accents; a null text has none."""
    return _WORD.findall(strip_marks(plain(text)).lower()) if text else []


def chunks(pdf: pd.DataFrame, column: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about so many characters each, so that long texts do not pile up."""
    sizes = pdf[column].map(lambda t: len(t) if t else 0).cumsum() // chars
    for _, part in pdf.groupby(sizes.to_numpy(), sort=False):
        yield part


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a small input comes in fewer partitions; large inputs stay as they are read."""
    sc = df.sparkSession.sparkContext
    return df.repartition(2 * sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df
