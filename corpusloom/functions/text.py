"""Caption expressions. All are native columns and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as blank, the markers around a
# decoded caption, the filler words and the closing words of a prompt suffix.
BLANK = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
INK = r"[^\x09-\x0d\x1c-\x20\x85\p{Z}]"
BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
START_MARK = "<start_of_text>"
END_MARK = "<end_of_text>"
TRAILING_JUNK = " .,"
FILLERS = ("there is", "this is")
SUFFIX_TAIL = "fine details, masterpiece"
WHITELIST = r"\A[\p{Ll}\p{Lu}\p{Nd}\p{Po}\p{Pd}\p{Zs}]*+\z"
NULL_WORDS = ("NULL", "null", "NaN")


def caption_head(c: Column, n: int = 15) -> Column:
    """The first ``n`` code points; a shorter text is kept whole, null stays null."""
    return F.left(c, F.lit(n))


def caption_tail(c: Column, n: int = 15) -> Column:
    """The last ``n`` code points; a shorter text is kept whole, null stays null."""
    return F.right(c, F.lit(n))


def strip_blank(c: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` by itself knows only the space)."""
    return F.trim(c, F.lit(BLANK_CHARACTERS))


def has_min_words(c: Column, n: int = 5) -> Column:
    """True for at least ``n`` words; the text is read only up to the n-th."""
    if n <= 0:
        return c.isNotNull()
    return c.rlike(rf"\A{BLANK}*+(?:{INK}++{BLANK}++){{{n - 1}}}{INK}")


def is_null_like(c: Column) -> Column:
    """True for null, blank text and the words that stand for a missing value.

    One line feed may follow, since ``$`` in the defining pattern allows it.
    """
    return c.isNull() | c.rlike(rf"\A(?:{BLANK}*|{'|'.join(NULL_WORDS)})\n?\z")


def is_plain_charset(c: Column) -> Column:
    """True if every character is a letter, digit, dash, other punctuation or space."""
    return c.rlike(WHITELIST)


def clean_caption(c: Column) -> Column:
    """Text before the first end mark, without start marks and trailing junk."""
    body = F.replace(F.substring_index(c, END_MARK, 1), F.lit(START_MARK), F.lit(""))
    return F.rtrim(body, F.lit(TRAILING_JUNK))


def strip_filler(c: Column, anchored: bool = False) -> Column:
    """Drop the filler words, one after the other, then strip.

    They go wherever they stand, even inside words; ``anchored`` removes them
    only at the start of the text.
    """
    for filler in FILLERS:
        if anchored:
            c = F.regexp_replace(c, rf"\A{BLANK}*{filler}", "")
        else:
            c = F.replace(c, F.lit(filler), F.lit(""))
    return strip_blank(c)


def tag_suffix(medium: Column, movement: Column, flavors: Column) -> Column:
    """``, {medium}, {movement}, {flavors}, `` and the closing words; flavors is an array."""
    return F.concat(
        F.lit(", "), medium, F.lit(", "), movement, F.lit(", "),
        F.array_join(flavors, ", "), F.lit(f", {SUFFIX_TAIL}"),
    )
