"""Tokenising texts as the queries need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, and the four separators that count as such too.
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = f"[{BLANKS}]+"
#: Stop words of the queries; as one string they also serve the substring test.
STOPWORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "de", "la", "der", "die", "en", "que", "le", "und", "des", "et"]
STOP_TEXT = " ".join(STOPWORDS)


def raw_tokens(text: Column) -> Column:
    """Split at white space, lower-case, drop the signs ( [ , . ! ? : ; ] )."""
    return F.transform(F.split(text, BLANK), lambda t: F.translate(F.lower(t), "([,.!?:;])", ""))


def letter_tokens(text: Column) -> Column:
    """Lower-case, keep letters and white space, split, without empty tokens."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), rf"[^\p{{L}}{BLANKS}]", ""), BLANK), lambda t: t != "")


def is_stopword(token: Column, mode: str = "exact", words: list[str] = STOPWORDS) -> Column:
    """exact: the token is a stop word; substring: it stands anywhere in the list's text (so short and empty tokens go).

    `words` is a list as `sources.files.read_stopwords` reads it.
    """
    return token.isin(words) if mode == "exact" else F.lit(" ".join(words)).contains(token)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))
