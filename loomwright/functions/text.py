"""Text column functions: stripping, word lists, number tests, identifier quoting, byte decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stopwords of the public Natural Language Toolkit, which never count as a matched value.
# fmt: off
STOPWORDS = [
    "who", "ourselves", "down", "only", "were", "him", "at", "weren't", "has", "few", "it's", "m", "again", "d",
    "haven", "been", "other", "we", "an", "own", "doing", "ma", "hers", "all", "haven't", "in", "but", "shouldn't",
    "does", "out", "aren", "you", "you'd", "himself", "isn't", "most", "y", "below", "is", "wasn't", "hasn", "them",
    "wouldn", "against", "this", "about", "there", "don", "that'll", "a", "being", "with", "your", "theirs", "its",
    "any", "why", "now", "during", "weren", "if", "should", "those", "be", "they", "o", "t", "of", "or", "me", "i",
    "some", "her", "do", "will", "yours", "for", "mightn", "nor", "needn", "the", "until", "couldn't", "he", "which",
    "yourself", "to", "needn't", "you're", "because", "their", "where", "it", "didn't", "ve", "whom", "should've",
    "can", "shan't", "on", "had", "have", "myself", "am", "don't", "under", "was", "won't", "these", "so", "as",
    "after", "above", "each", "ours", "hadn", "having", "wasn", "s", "doesn", "hadn't", "than", "by", "that", "both",
    "herself", "his", "wouldn't", "into", "doesn't", "before", "my", "won", "more", "are", "through", "same", "how",
    "what", "over", "ll", "yourselves", "up", "mustn", "mustn't", "she's", "re", "such", "didn", "you'll", "shan",
    "when", "you've", "themselves", "mightn't", "she", "from", "isn", "ain", "between", "once", "here", "shouldn",
    "our", "and", "not", "too", "very", "further", "while", "off", "couldn", "hasn't", "itself", "then", "did", "just",
    "aren't",
]
# fmt: on

# Words that only count when they match exactly, and names too general to be a value.
COMMON_WORDS = ["no", "yes", "many"]
DATABASE_TERMS = ["id"]

# The characters that end a word, and those that force quoting of a name.
SEPARATORS = "'\"()`,.?! "
SPECIAL_NAME_CHARACTERS = "(-) /"

MAX_VALUE_LENGTH = 25


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` would only remove blanks).

    The class holds the control separators U+001C to U+001F too, which Python's ``str.strip`` removes.
    """
    c = F.col(c) if isinstance(c, str) else c
    blank = r"(?U)[\s\x1c-\x1f]"
    # only a text with a blank at an end is searched, and one of broken bytes, which reading as text mends
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(blank) | ~F.is_valid_utf8(c), F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).otherwise(c)


def is_short_value(c: Column | str, limit: int = MAX_VALUE_LENGTH) -> Column:
    """True for stripped text of 1 to ``limit`` characters."""
    return F.length(c).between(1, limit)


def is_stopword(c: Column | str) -> Column:
    return strip(c).isin(STOPWORDS)


def is_common_word(c: Column | str) -> Column:
    return strip(c).isin(COMMON_WORDS)


def is_database_term(c: Column | str) -> Column:
    return strip(c).isin(DATABASE_TERMS)


def is_filtered_word(c: Column | str) -> Column:
    """True when the word can never stand for a value by itself."""
    return strip(c).isin(STOPWORDS + COMMON_WORDS + DATABASE_TERMS)


# Fixed value: the texts that Python's float() reads. Java's own number syntax would also take "1d" and hexadecimal.
_FLOAT = (
    r"(?iU)^[\s\x1c-\x1f]*[+-]?(inf(inity)?|nan|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)[\s\x1c-\x1f]*\z"
)


def is_number(c: Column | str, drop_commas: bool = True) -> Column:
    """True when the text reads as a float, with thousands commas dropped first if asked."""
    c = F.col(c) if isinstance(c, str) else c
    if drop_commas:
        c = F.replace(c, F.lit(","), F.lit(""))
    return F.coalesce(c.rlike(_FLOAT), F.lit(False))


def quote_identifier(c: Column | str) -> Column:
    """Back-quote a name that holds a blank, hyphen, slash or parenthesis."""
    c = F.col(c) if isinstance(c, str) else c
    tick = F.lit("`")
    return F.when(c.rlike(r"[(\-) /]"), F.concat(tick, c, tick)).otherwise(c)


def decode_text(c: Column | str) -> Column:
    """Bytes to text: UTF-8 when valid, else Latin-1."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.is_valid_utf8(c.cast("string")), F.decode(c, "UTF-8")).otherwise(F.decode(c, "ISO-8859-1"))


def decode_text_dropping(c: Column | str) -> Column:
    """Bytes to text as UTF-8, invalid bytes dropped. A genuine U+FFFD in the input is dropped with them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.make_valid_utf8(c.cast("string")), F.lit("�"), F.lit(""))


def number_text(c: Column | str) -> Column:
    """A double as Python's ``str`` writes it: plain digits from 1e-4 up to 1e16, else ``d.ddde+XX``."""
    c = F.col(c) if isinstance(c, str) else c
    return python_number(c.cast("string"))


def python_number(text: Column) -> Column:
    """Spark's text of a double in Python's form. Only texts with an exponent and the special values differ."""
    value = text.cast("double")
    digits = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    exponent = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1")
    exponent = F.regexp_replace(F.regexp_replace(exponent, "E-", "e-"), r"e-(\d)$", "e-0$1")
    plain = (F.abs(value) < 1e16) & (F.abs(value) >= 1e-4)
    special = F.when(text == "NaN", "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
    return F.when(F.contains(text, F.lit("E")), F.when(plain, digits).otherwise(exponent)).otherwise(
        F.coalesce(special, text)
    )
