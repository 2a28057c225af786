"""Plain words: the common normal form in which transcripts are compared and counted."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that carry no sound and are removed.
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"

_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_RUN = re.compile(r"[^\W_]+")
_GAP = re.compile(r"\s")


def plain_form(text: str) -> str:
    """Entities resolved once, NFC, invisible characters gone, lower case, ß as ss."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = _INVISIBLE.sub("", text)
        return text.lower().replace("ß", "ss")
    return text.lower()


def plain_words(text: str | None) -> list[str]:
    """The longest runs of letters or digits of the plain form, in order; none for null."""
    return _RUN.findall(plain_form(text)) if text else []


def plain_word_parts(text: str | None, part: int = 1 << 20) -> Iterator[list[str]]:
    """``plain_words`` in parts, so that a huge text never holds all its words at once.

    Parts end at white space, where neither an entity nor a composition nor a
    word can cross.
    """
    if not text:
        return
    at, n = 0, len(text)
    while at < n:
        end = at + part
        if end < n:
            gap = _GAP.search(text, end)
            end = gap.start() if gap else n
        words = plain_words(text[at:end])
        if words:
            yield words
        at = end


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_words_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: plain_words(t if isinstance(t, str) else None))
