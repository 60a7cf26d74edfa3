"""Text columns: positions count from 0, unparsable numbers are missing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..missing import quoted
from .conditions import parse_bigint, parse_double


# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(col: str | Column) -> Column:
    return quoted(col) if isinstance(col, str) else col


def substr(col: str | Column, start: int, length: int) -> Column:
    """``length`` characters from 0-based ``start``."""
    return F.substring(_col(col), start + 1, length)


def substr_int(col: str | Column, start: int, length: int) -> Column:
    return parse_bigint(substr(col, start, length))


def substr_double(col: str | Column, start: int, length: int) -> Column:
    return parse_double(substr(col, start, length))


def index_of(col: str | Column, text: str) -> Column:
    """0-based position of ``text``, -1 if absent."""
    return F.instr(_col(col), text) - 1


def int_after(col: str | Column, mark: str, offset: int, length: int) -> Column:
    """Integer in the ``length`` characters that start ``offset`` after the mark; missing without it."""
    place = F.instr(_col(col), mark)
    return F.when(place > 0, parse_bigint(F.substr(_col(col), place + F.lit(offset), F.lit(length))))


def double_before(col: str | Column, mark: str, offset: int = 0) -> Column:
    """Double in the text up to ``offset`` characters past the mark; missing without it."""
    place = F.instr(_col(col), mark)
    return F.when(place > 0, parse_double(F.substr(_col(col), F.lit(1), place - 1 + F.lit(offset))))


def upper_case(col: str | Column) -> Column:
    return F.upper(_col(col))


def lower_case(col: str | Column) -> Column:
    return F.lower(_col(col))


def length(col: str | Column) -> Column:
    return F.length(_col(col)).cast("bigint")


def strip(col: str | Column) -> Column:
    """Without white space at both ends, that of Unicode included."""
    return F.btrim(_col(col), F.lit(WHITE_SPACE))


def replace(col: str | Column, old: str, new: str, regex: bool = False) -> Column:
    if regex:
        return F.regexp_replace(_col(col), old, new)
    return F.replace(_col(col), F.lit(old), F.lit(new))


def replace_text(df: DataFrame, col: str, old: str, new: str, regex: bool = False) -> DataFrame:
    return df.withColumn(col, replace(col, old, new, regex))


def join_text(sep: str, *cols: str | Column, skip_missing: bool = True) -> Column:
    """Values joined by ``sep``; a missing value is skipped or makes the result missing."""
    texts = [_col(c).cast("string") for c in cols]
    if skip_missing:
        return F.concat_ws(sep, *texts)
    spaced = [p for t in texts for p in (F.lit(sep), t)][1:]
    return F.concat(*spaced)


def to_string(col: str | Column) -> Column:
    """As text; missing stays missing, NaN included."""
    return F.when(~_is_nan(_col(col)), _col(col).cast("string"))


def _is_nan(col: Column) -> Column:
    """True for NaN; false for all else, whatever its type."""
    return F.typeof(col).isin("float", "double") & F.coalesce(col.cast("string") == "NaN", F.lit(False))


def to_int(col: str | Column) -> Column:
    return parse_bigint(_col(col))


def to_double(col: str | Column) -> Column:
    return parse_double(_col(col).cast("string"))


def missing(col: str | Column) -> Column:
    """Whether the value is missing: NULL, or NaN in a float column."""
    return _col(col).isNull() | _is_nan(_col(col))


def split_cell(df: DataFrame, col: str, sep: str = ",", n: int | None = None) -> DataFrame:
    """Split a text into columns ``<col>_0`` … ``<col>_<n-1>``; short rows end in missing values.

    Without ``n``, as the rows differ in their parts, one array column ``<col>_parts`` holds them.
    """
    parts = F.split(quoted(col), _literal_pattern(sep))
    if n is None:
        return df.withColumn(f"{col}_parts", parts)
    return df.withColumns({f"{col}_{i}": F.get(parts, F.lit(i)) for i in range(n)})


def _literal_pattern(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\s])", r"\\\1", text)


def last_line(col: str | Column) -> Column:
    """Last line of a text, without outer white space; an empty text gives an empty one."""
    return strip(F.element_at(F.split(strip(col), r"\r\n|\n|\r"), -1))


def truncate_text(col: str | Column, n: int) -> Column:
    """First ``n`` characters, empty if missing."""
    return F.substring(F.coalesce(_col(col).cast("string"), F.lit("")), 1, n)
