"""Payment card numbers as Column expressions: candidates, checksum, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, strip

NAME = "pan"
DATATYPE = "Primary Account Number"

# The brands' number formats, and the characters that may not stand beside a number.
# \p{Nd} stands for the decimal digits of all scripts.
BRANDS = {
    "visa": r"4[0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "mc": r"5[1-5][0-9]{2}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "discover": r"6011[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "jcb": r"(?:2131|1800|35[0-9]{3})[0-9]{11}",
    "amex": r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}",
}
BEFORE, AFTER = r"(?:^|[^\p{Nd}.-])", r"(?:$|[^\p{Nd}.-])"

#: What every format has: four digits, a separator or none, four digits. Rows without it skip the brands' patterns.
ANY = "[0-9]{4}[ -]?[0-9]{4}"
#: The same before white space is normalised. Digits are written singly, since a counted class costs more at every character.
ANY_RAW = "[0-9]" * 4 + rf"(?:-|{WHITESPACE}+)?+" + "[0-9]" * 4
#: In texts of up to so many characters a brand is sought at once, which costs less than to find what is near digits.
SHORT = 1000


def may_hold(text: Column) -> Column:
    """False where a text, its white space normalised or not, has no candidates of any brand and so need not be normalised."""
    return text.rlike(ANY_RAW)


def near_digits(text: Column) -> Column:
    """The digits with all that stands beside them: of three and more other characters in succession the first and the last stay, and every brand matches as in the whole text."""
    return F.regexp_replace(text, "([^0-9])[^0-9]+([^0-9])", "$1$2")


def candidates(text: Column, brand: str, lookaround: bool = False) -> Column:
    """Stripped matches with the neighbours they consume. lookaround: neighbours are only looked at, so numbers one blank apart are both found."""
    # a format of several beginnings would be tried at every character, so a digit is looked for first
    first = "(?=[0-9])" if BRANDS[brand].startswith("(?:") else ""
    pattern = rf"(?<![\p{{Nd}}.-]){BRANDS[brand]}(?![\p{{Nd}}.-])" if lookaround else BEFORE + first + BRANDS[brand] + AFTER
    near = F.when(F.length(text) > SHORT, near_digits(text)).otherwise(text)
    found = F.regexp_extract_all(near, F.lit(pattern), F.lit(0))
    return F.transform(found, strip)


def is_valid(text: Column) -> Column:
    """Luhn checksum of the ASCII digits."""
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def redact(text: Column, mask: str = "*") -> Column:
    """First six and last four digits stay, and everything that isn't a digit stays where it is."""
    # one pass: a match takes the first six digits, or goes on where the last one ended, up to one more digit that has four behind it;
    # written out and possessive, as a repeated group keeps its steps to go back
    digit = "[^0-9]*+[0-9]"
    hidden = rf"(^{digit * 6}[^0-9]*+|\G(?!^)[^0-9]*+)[0-9](?={digit * 4})"
    return F.regexp_replace(text, hidden, "$1" + mask.replace("\\", r"\\").replace("$", r"\$"))


def find(text: Column, mode: str = "distinct", lookaround: bool = False) -> Column:
    """array<struct<key, value>> of the redacted numbers of a text.

    mode: 'distinct' for every distinct value, 'last_per_brand' for the last valid number of each brand only.
    """
    entry = "array<struct<key: string, value: string>>"

    def of(near: Column, brand: str) -> Column:
        valid = F.filter(candidates(near, brand, lookaround), is_valid)
        if mode == "last_per_brand":
            valid = F.slice(valid, -1, 1)
        values = F.array_distinct(F.transform(valid, lambda v: redact(v)))
        return F.transform(values, lambda v: F.struct(F.lit(brand).alias("key"), v.alias("value")))

    def every(near: Column) -> Column:
        return F.when(near.rlike(ANY), F.concat(*(of(near, brand) for brand in BRANDS))).otherwise(F.array().cast(entry))

    # as the variable of a lambda, what is near digits is worked out once for all brands
    return F.when(text.isNull(), F.array().cast(entry)).otherwise(F.flatten(F.transform(F.array(near_digits(text)), every)))
