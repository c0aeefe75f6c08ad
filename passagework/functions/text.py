"""Text helpers, all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.fixed_values import ANSWER_PREVIEW, THINK_END, WHITESPACE

TOKEN = "[^ \t\n\r\f\x0b]+"
WORD = r"[\p{L}\p{N}]+"


def strip(col) -> Column:
    """Remove whitespace of any kind from both ends.

    The characters go in as a literal: inside a SQL string ``'\\f'`` would
    parse as the letter f.
    """
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITESPACE))


def text_or_empty(col) -> Column:
    """Null or missing becomes the empty string; everything else its text form."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def is_blank(col) -> Column:
    return F.length(strip(col)) == 0


def preview(col, n: int = ANSWER_PREVIEW, always: bool = False) -> Column:
    """First ``n`` characters; an ellipsis follows when something was cut off
    (or in every case with ``always``)."""
    col = F.col(col) if isinstance(col, str) else col
    cut = F.concat(F.substring(col, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(col) > n, cut).otherwise(col)


def strip_think(col) -> Column:
    """Text after the first reasoning end marker, or all of it, trimmed."""
    col = F.col(col) if isinstance(col, str) else col
    at = F.instr(col, THINK_END)
    rest = F.substr(col, at + F.lit(len(THINK_END)))
    return strip(F.when(at > 0, rest).otherwise(col))


def contains_any(lowered: Column, words) -> Column:
    """True when the (already lower-cased) text contains any of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word.lower()))
    return hit


def whitespace_tokens(col) -> Column:
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def whitespace_token_count(col) -> Column:
    return F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(TOKEN))


def cut_tokens(col, n: int) -> Column:
    """The text up to its ``n``-th token; shorter texts stay as they are."""
    col = F.col(col) if isinstance(col, str) else col
    pieces = F.regexp_extract_all(col, F.lit(f"[ \t\n\r\f\x0b]*{TOKEN}"), F.lit(0))
    return F.when(F.size(pieces) > n, F.array_join(F.slice(pieces, 1, n), "")).otherwise(col)


def words(col) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def md5_int(col: Column, digits: int) -> Column:
    """First hex digits of the MD5 as a number; the same on every engine."""
    return F.conv(F.substring(F.md5(col), 1, digits), 16, 10).cast("bigint")
