"""Column expressions that turn raw text into words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a word, and the longest word that is kept, in bytes.
SEPARATORS = r"\r\n,.!?\"\-_:;(){}"
LONGEST_WORD = 27

# A short English stop list; any single-column DataFrame can take its place.
STOP_WORDS = "a an and are as at be by for from he in is it of on or that the this to was were with".split()


# A token is what stands between spaces and line ends. Its word: what follows leading separators and non-ASCII characters,
# up to the next separator.
_TOKEN = f"(?=[^ \\n])[{SEPARATORS}&&[^\\n]]*+[^\\x00-\\x7F]*+([^{SEPARATORS} ]*+)[^ \\n]*+"


def raw_words(text: Column) -> Column:
    """The words of all tokens of a text, as an array, before their bytes above 127 and their case are seen to: one pass."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))


def normalise(word: Column) -> Column:
    """A raw word without non-ASCII characters at its end, in lower case. Within a word a byte above 127 becomes an
    apostrophe and swallows the next two bytes. The byte-wise branch is taken by words that hold such bytes only."""
    inner = F.regexp_replace(word, r"[^\x00-\x7F]+$", "")
    as_bytes = F.decode(F.encode(inner, "UTF-8"), "ISO-8859-1")
    byte_wise = F.regexp_replace(as_bytes, r"(?s)[\x80-\xFF].{0,2}", "'")
    return F.lower(F.when(F.octet_length(word) == F.length(word), word).otherwise(byte_wise))


# The same in Python, on bytes. The class of separators without \n holds what can precede a word within a token.
_BYTE_TOKEN = re.compile(rb"(?=[^ \n])[\r,.!?\"\-_:;(){}]*+[\x80-\xff]*+([^\r\n,.!?\"\-_:;(){} ]*+)[^ \n]*+")
_SWALLOWED = re.compile(rb"(?s)[\x80-\xff].{0,2}")
_HIGH = bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a text (UTF-8), from 1 to LONGEST_WORD bytes long: what raw_words and normalise make of it."""
    if text.isascii():
        return [w for w in _BYTE_TOKEN.findall(text.lower()) if 0 < len(w) <= LONGEST_WORD]
    try:
        text.decode()
    except UnicodeDecodeError:
        text = text.decode(errors="replace").encode()
    raw = _BYTE_TOKEN.findall(text.lower())  # of bytes: A-Z only
    words = [w if w.isascii() else _SWALLOWED.sub(b"'", w.rstrip(_HIGH)) for w in raw]
    return [w for w in words if 0 < len(w) <= LONGEST_WORD]


def bucket(word: Column) -> Column:
    """0 to 25 for words that start with a letter a-z, 26 for all others, which come last in vocabulary order."""
    return F.when((word >= "a") & (word < "{"), F.ascii(word) - 97).otherwise(26)


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an md5 of the parts: the same in every run, engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def hash_int(k: int, *parts: Column) -> Column:
    """A number in 0 to k - 1, likewise."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("int")
