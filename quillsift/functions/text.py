"""Text shaping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as white space, the size of a chunk, the units of a size.
# Those of one byte are named singly and the others by category, because the matcher tries every range of a class at every character.
WHITESPACE = r"[\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\p{Z}]+"
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CHUNK_SIZE = 650
SIZE_UNITS = ("", "K", "M", "G", "T", "P", "E", "Z", "Y")


def normalize(text: Column) -> Column:
    """Words separated by single blanks; null stays null."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip(text: Column) -> Column:
    """Without white space at both ends; no pattern, since it runs for every value that is found."""
    return F.trim(text, F.lit(SPACES))


def make_chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Whole words packed into chunks that end with the word that reaches `size`.

    Words over `size` are left out where they stand, and their pieces follow after the last word. A chunk is the shortest run of words of
    `size` - 1 characters or more, so one lazy pattern cuts the text in linear time.
    """
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > size)
    pieces = F.flatten(F.transform(long, lambda w: F.regexp_extract_all(w, F.lit(f".{{1,{size}}}"), F.lit(0))))
    line = F.array_join(F.concat(F.filter(words, lambda w: F.length(w) <= size), pieces), " ")
    pattern = rf"[^ ].{{{max(0, size - 2)},}}?(?= |\z)|[^ ].*\z" if size > 1 else r"[^ ]+"
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def sizeof_fmt(num: Column, suffix: str = "B") -> Column:
    """1024-based size with one decimal; halves go to the even digit."""
    value = num.cast("double")
    out = F.format_string(f"%.1f{SIZE_UNITS[-1]}{suffix}", F.bround(value / 1024.0 ** (len(SIZE_UNITS) - 1), 1))
    for power in range(len(SIZE_UNITS) - 2, -1, -1):
        scaled = value / 1024.0**power
        out = F.when(F.abs(scaled) < 1024.0, F.format_string(f"%.1f{SIZE_UNITS[power]}{suffix}", F.bround(scaled, 1))).otherwise(out)
    return F.when(num.isNotNull(), out)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; '' for names without one, names that only start with a dot, and names that end with one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)
