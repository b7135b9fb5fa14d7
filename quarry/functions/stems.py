"""Words without their endings, as Column expressions: forms of one Russian word get one key; other words stay as they are."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of case and number, the longest first, and vowels.
ENDINGS = ("иями", "ями", "ами", "ыми", "ими", "ого", "его", "ому", "ему", "ой", "ей", "ом", "ем", "ам", "ям", "ах", "ях", "ую", "юю", "ая", "яя", "ое", "ее", "ие", "ые", "ия", "ии", "ию", "а", "я", "о", "е", "и", "ы", "у", "ю", "ь", "й")
VOWELS = "аеёиоуыэюя"

#: A stem of three characters or more and an ending; a consonant behind a vowel that drops out in other cases.
WITH_ENDING = f"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$"
FLEETING = f"^(.{{2,}})[{VOWELS}]([^{VOWELS}])$"


def stem(word: Column) -> Column:
    """The word without its longest known ending, if three characters are left."""
    may = F.contains(F.lit("".join(sorted({e[-1] for e in ENDINGS}))), F.right(word, F.lit(1)))  # few words of other languages need the pattern
    return F.when(may, F.regexp_replace(word, WITH_ENDING, "$1")).otherwise(word)


def without_fleeting(stem: Column) -> Column:
    """The stem without a vowel before its last consonant."""
    may = F.contains(F.lit(VOWELS), F.substring(stem, -2, 1))
    return F.when(may, F.regexp_replace(stem, FLEETING, "$1$2")).otherwise(stem)


def term_key(word: Column) -> Column:
    """One key for the forms of a word: lower case, ё as е, no ending, no fleeting vowel."""
    return without_fleeting(stem(F.translate(F.lower(word), "ё", "е")))


def term_keys(words: pa.Array) -> pa.Array:
    """term_key of words in lower case, for an Arrow array."""
    stems = pc.replace_substring_regex(pc.replace_substring(words, "ё", "е"), WITH_ENDING, r"\1")
    return pc.replace_substring_regex(stems, FLEETING, r"\1\2")


def same_word(a: Column, b: Column) -> Column:
    """Whether two words (lower case, ё as е) are forms of one: stems that are alike, on either side without its fleeting vowel."""
    x, y = stem(a), stem(b)
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= 3) & ((x == y) | (without_fleeting(x) == y) | (x == without_fleeting(y))))


def same_phrase(a: Column, b: Column) -> Column:
    """Whether two phrases have as many words and each is a form of the other's."""
    x, y = F.split(F.trim(a), r"\s+"), F.split(F.trim(b), r"\s+")
    pairs = F.zip_with(x, y, same_word)
    return (F.size(x) == F.size(y)) & F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))
