"""Text kernel: normal form, search terms, relevance, highlighting, clean-up. Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searches ignore. Fixed values.
STOP_WORDS = ("a", "o", "e", "de", "da", "do", "em", "na", "no", "com", "por", "para", "um", "uma", "os", "as", "dos", "das")


def _accents() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one ASCII letter and marks, and those letters."""
    source = target = ""
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            source, target = source + chr(code), target + parts[0]
    return source, target


_SOURCE, _TARGET = _accents()


def normalize(text: Column) -> Column:
    """Lower case without accents, letters a-z, digits and single spaces only."""
    plain = F.translate(F.lower(text), _SOURCE, _TARGET)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\t\n\f\r ]", ""), r"[\t\n\f\r ]+", " "))


def normalized(text: str) -> str:
    parts = unicodedata.normalize("NFD", text.lower())
    kept = re.sub(r"[^a-z0-9\t\n\f\r ]", "", unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn")))
    return re.sub(r"[\t\n\f\r ]+", " ", kept).strip()


def search_terms(query: str) -> list[str]:
    return [t for t in normalized(query).split() if len(t) >= 2 and t not in STOP_WORDS]


def terms(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP_WORDS))


def relevance(text: Column, words: list[str]) -> Column:
    """Occurrences of the words, longer words weighing more, over the number of words."""
    if not words:
        return F.lit(0.0)
    plain = normalize(text)
    total = F.lit(0.0)
    for word in words:
        total = total + F.regexp_count(plain, F.lit(re.escape(word))) * F.lit(1.0 + len(word.encode()) / 10.0)
    return total / F.lit(float(len(words)))


def matches_any(text: Column, words: list[str]) -> Column:
    plain, found = normalize(text), F.lit(False)
    for word in words:
        found = found | plain.contains(word)
    return found


def highlight(text: Column, words: list[str]) -> Column:
    for word in words:
        text = F.regexp_replace(text, F.lit(f"(?iu){re.escape(word)}"), F.lit("<mark>$0</mark>"))
    return text


def content(text: Column) -> Column:
    """Line breaks and runs of spaces as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\n\t\r ]+", " ")))


def sanitize(text: Column, most: int) -> Column:
    """Without characters that markup gives a meaning, trimmed, at most so many characters."""
    return F.substring(F.trim(F.translate(text, "<>\"'&", "")), 1, most)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def truncate_shown(text: Column, most: int = 150) -> Column:
    """As pages show it: cut by characters, and trimmed before the dots."""
    return F.when(F.length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)
