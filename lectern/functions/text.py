"""Text expressions shared by the operators.

A token is a maximal run of characters other than Unicode white space; a word is a
maximal run of Unicode letters or digits compared in lower case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the code points with the Unicode property White_Space, as a class body
# that Java, Python and RE2 expressions share.
SPACE = r"\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same code points as text, for Python's classes.
SPACE_PY = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

TOKEN_PY = re.compile(f"[^{SPACE_PY}]+")
WORD_PY = re.compile(r"[^\W_]+")


def squeeze(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def tokens(text: Column) -> Column:
    """The tokens in their order; null for null."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(tokens(text)))


def words(text: Column) -> Column:
    """Lower-case words in their order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens."""
    return F.array_distinct(tokens(F.lower(text)))


def decoded(data: Column) -> Column:
    """Bytes read as UTF-8; what can't be read is left out."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))
