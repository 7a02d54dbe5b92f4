"""Terminal cells: how wide a text is, and cutting and filling it to a width."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(65536)
def char_width(c: str) -> int:
    """0 for what takes no cell (control and combining characters), 2 for wide ones, else 1."""
    if unicodedata.category(c) in ("Cc", "Mn", "Me", "Cf") and c != "\xad":
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def text_width(text: str) -> int:
    if text.isascii() and text.isprintable():
        return len(text)
    return sum(map(char_width, text))


def truncate_text(text: str, width: int) -> str:
    """Text that fits stays; else what fits one cell less, and an ellipsis."""
    if width <= 0:
        return ""
    if text_width(text) <= width:
        return text
    out, used = [], 0
    for c in text:
        if used + char_width(c) > width - 1:
            break
        out.append(c)
        used += char_width(c)
    return "".join(out) + "…"


@F.pandas_udf(T.IntegerType())
def _width(texts: pd.Series) -> pd.Series:
    return texts.map(text_width, na_action="ignore").astype("Int32")


@F.pandas_udf(T.StringType())
def _truncate(texts: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else truncate_text(t, int(w)) for t, w in zip(texts, widths)])


def width(text: Column) -> Column:
    """Cells that a text takes."""
    return _width(text)


def truncate(text: Column, cells: Column) -> Column:
    return _truncate(text, cells)


def pad(text: Column, cells: Column, align: int = 0) -> Column:
    """Filled with spaces to a width: 0 left-aligned, 1 centred (the odd space right), 2 right-aligned; never cut."""
    room = F.greatest(cells - width(text), F.lit(0))
    left = F.lit(0) if align == 0 else F.floor(room / 2).cast("int") if align == 1 else room
    return F.concat(F.repeat(F.lit(" "), left), text, F.repeat(F.lit(" "), (room - left).cast("int")))
