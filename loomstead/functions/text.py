"""Column functions on text: words, token ids, clean-up rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: First id that the word tokenizer leaves free: the mark at the head of each document.
BOS = 50256
#: White space as Unicode-aware regular expressions define it, spelled out.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_ids(text: Column, vocabulary: int = BOS) -> Column:
    """A reproducible id below ``vocabulary`` for each word: the first 16 bits of its MD5."""
    return F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % vocabulary)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_choice_text(text: Column) -> Column:
    """Strip, turn " [title]" into ". ", drop bracketed notes, collapse white space."""
    out = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    out = F.regexp_replace(out, r"\[[^\]]*\]", "")
    return strip(F.regexp_replace(out, f"{SPACE}+", " "))


def first_upper(text: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def safe_name(name: Column, default: str = "item") -> Column:
    """A name for files: other characters collapse to "_", none at the ends."""
    out = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(F.length(out), F.lit(0)) == 0, F.lit(default)).otherwise(out)


def canonical_category(value: Column) -> Column:
    """A category's display name: stripped, "_" as space, "<NA>" where it is missing."""
    return F.coalesce(F.replace(F.trim(value), F.lit("_"), F.lit(" ")), F.lit("<NA>"))
