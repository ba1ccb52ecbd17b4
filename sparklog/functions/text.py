"""Text rules: blanks, redaction, previews, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog import constants as C

# The Unicode spaces that browsers fold, besides the ASCII ones.
UNICODE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
DIGITS = "0123456789"


def not_blank(col: Column) -> Column:
    """True if the text has a character above U+0020; false for null."""
    return F.coalesce(col.rlike(r"[^\x00-\x20]"), F.lit(False))


def _has_any(col: Column, chars: str) -> Column:
    """Byte search for any of the characters, much cheaper than a regular expression."""
    return reduce(lambda found, char: found | F.contains(col, F.lit(char)), chars[1:], F.contains(col, F.lit(chars[0])))


def redact(col: Column) -> Column:
    """Replace e-mail addresses, IPv4 shapes and card-like digit runs, in this order.

    No address lacks an ``@``, no IPv4 shape a dot, and neither it nor a card a digit, and a replacement
    adds none of them; so most texts need no regular expression at all.
    """
    def apply(text: Column, rule: tuple[str, str]) -> Column:
        return F.regexp_replace(text, rule[0], F.lit(rule[1]))

    email, ip, card = C.PII_RULES
    no_email = F.when(F.contains(col, F.lit("@")), apply(col, email)).otherwise(col)
    no_ip = F.when(F.contains(col, F.lit(".")), apply(no_email, ip)).otherwise(no_email)
    return F.when(_has_any(col, DIGITS), apply(no_ip, card)).otherwise(no_email)


def _fold_spaces(col: Column) -> Column:
    """Runs of white space as one blank. Single blanks, the common case, are left alone."""
    ascii_only = reduce(lambda text, space: F.replace(text, F.lit(space), F.lit(" ")), UNICODE_SPACES, col)
    return F.regexp_replace(
        F.when(_has_any(col, UNICODE_SPACES), ascii_only).otherwise(col), r"[^\S ]\s*| \s+", " "
    )


def preview(col: Column, width: int = 90) -> Column:
    """One-line preview: spaces folded, rulers removed, cut with an ellipsis."""
    folded = F.trim(_fold_spaces(F.coalesce(col, F.lit(""))))
    no_rulers = F.trim(F.regexp_replace(folded, "={3,}", ""))
    clean = F.when(F.contains(col, F.lit("===")), no_rulers).otherwise(folded)
    return F.concat(F.substring(clean, 1, width), F.when(F.length(clean) > width, "...").otherwise(""))


def has_text(col: Column, word: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(col), F.lit(word.lower()))


def has_token(col: Column, word: str) -> Column:
    """True if one token (a run of letters, digits and underscores) contains the word.

    A word of token characters lies inside one token wherever it occurs, so a substring test is enough;
    a word with any other character lies in none.
    """
    inside = bool(word) and all(char.isalnum() or char == "_" for char in word)
    return has_text(col, word) if inside else F.lit(False)


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)
