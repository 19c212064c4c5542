"""Column expressions over text: clipping, sentence splitting, token counts.

Every pattern is written with explicit character classes so that Java
regular expressions (Spark) and RE2 (the SQL oracle) behave the same:
no ``\\s``, ``.`` or ``\\b``, no look-behind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lisible.constants import CLIP_SUFFIX

# --- fixed values: abbreviations kept attached to their period (French first) ---
ABBREVIATIONS = [
    "M", "MM", "Mme", "Mmes", "Mlle", "Mlles", "Mgr", "Me", "Dr", "Pr", "St", "Ste",
    "etc", "cf", "env", "av", "apr", "vol", "chap", "fig", "éd", "p", "pp", "art",
    "al", "ex", "Mr", "Mrs", "Ms", "Prof", "Jr", "Sr", "vs",
]

WS = r"[ \t\n\r]"
# marks are an escape character and a second one; the escape character itself is escaped in the text first,
# so texts that hold these private-use characters come back unchanged
ESCAPE = "\ue000"
ESCAPED = ESCAPE + "\ue001"   # the escape character as text
PROTECT = ESCAPE + "\ue002"   # a period that does not end a sentence
MARK = ESCAPE + "\ue003"      # sentence boundary
# end punctuation, closing marks, and French spaced closing guillemets, then blanks
SENT_END = r"([.!?…]+[»\"”’)\]]*(?:[ \x{00A0}]+[»”])*)" + WS + "+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r]"
WORD = r"[\p{L}]+"
LONG_WORD_TEMPLATE = r"[\p{L}]{%d,}"
TRIM = r"^[ \t\n\r]+|[ \t\n\r]+$"
SPECIAL_TOKENS = 2   # begin and end markers added by the encoder


def protect_pattern(abbreviations: list[str] | None = None) -> str:
    alts = "|".join(abbreviations if abbreviations is not None else ABBREVIATIONS)
    alts = (alts + "|") if alts else ""
    return r"(^|[^\p{L}\p{N}])(" + alts + r"\p{Lu})[.]"


def _protect_quickly(abbreviations: list[str] | None = None) -> tuple[str, str]:
    """``protect_pattern`` for Java, with its replacement: looks back from a period, so that words without one cost nothing.

    The character before the word may not be the period of the last match, as
    if it had been taken with the word (``M.M.``: the second is not protected).
    """
    known = abbreviations if abbreviations is not None else ABBREVIATIONS
    if not all(a.isalpha() for a in known):
        return protect_pattern(abbreviations), "$1$2" + PROTECT
    return r"[.](?<=(?:^|(?<![\p{L}\p{N}])(?!\G))(?:%s)[.])" % "|".join([*known, r"\p{Lu}"]), PROTECT


def clip(c: Column, n: int) -> Column:
    """First ``n`` code points, with ``...`` appended when the text was longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(CLIP_SUFFIX))).otherwise(c)


def strip_ws(c: Column) -> Column:
    """Blanks (WS) off both ends; only before a final line separator that is no blank does the pattern see an end of its own."""
    odd = c.endswith("\u0085") | c.endswith("\u2028") | c.endswith("\u2029")
    return F.when(odd, F.regexp_replace(c, TRIM, "")).otherwise(F.btrim(c, F.lit(" \t\n\r")))


def sentence_array(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Split text into an ordered array of non-empty sentences.

    Mark-and-split: periods of known abbreviations and initials are
    protected, a boundary is marked after end punctuation (with closing
    quotes) followed by blanks, then the text is split at the marks.
    """
    escaped = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED))
    protected = F.regexp_replace(escaped, *_protect_quickly(abbreviations))
    marked = F.regexp_replace(protected, SENT_END, "$1" + MARK)
    parts = F.split(F.replace(marked, F.lit(PROTECT), F.lit(".")), MARK)
    cleaned = F.transform(parts, lambda s: F.replace(strip_ws(s), F.lit(ESCAPED), F.lit(ESCAPE)))
    return F.filter(cleaned, lambda s: s != "")


def token_count(sentence: Column) -> Column:
    """Encoded length: letter/digit runs and single symbols, plus the two specials."""
    return F.regexp_count(sentence, F.lit(TOKEN)) + F.lit(SPECIAL_TOKENS)


def within_tokens(sentence: Column, max_tokens: int) -> Column:
    """``token_count(sentence) <= max_tokens``; a token has one character at least, so only long sentences are counted."""
    return (F.length(sentence) <= F.lit(max_tokens - SPECIAL_TOKENS)) | (token_count(sentence) <= F.lit(max_tokens))


def word_count(sentence: Column) -> Column:
    return F.regexp_count(sentence, F.lit(WORD))


def long_word_count(sentence: Column, min_letters: int) -> Column:
    return F.regexp_count(sentence, F.lit(LONG_WORD_TEMPLATE % min_letters))


#: What is no letter and the word after it, with the letter that makes it long.
NEXT_WORD = r"[^\p{L}]*+(?:[\p{L}]{%d}([\p{L}])[\p{L}]*+|[\p{L}]++)"


def word_marks(sentence: Column, min_letters: int) -> Column:
    """A ``1`` for every word, and a letter after it if the word is long: one pass for ``words_of`` and ``long_words_of``.

    One more word stands at the end, so that nothing is left after the last match.
    """
    return F.regexp_replace(F.concat(sentence, F.lit(" a")), F.lit(NEXT_WORD % (min_letters - 1)), F.lit("1$1"))


def long_words_of(marks: Column) -> Column:
    return F.length(F.replace(marks, F.lit("1"), F.lit("")))


def words_of(marks: Column) -> Column:
    """Words of ``word_marks``, without the one at the end."""
    return F.length(marks) - long_words_of(marks) - F.lit(1)
