"""E-mail addresses as Column expressions: candidates, validity, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE

NAME = "email"
DATATYPE = "Email Address"

# The characters of an address.
ATOM = r"[a-zA-Z0-9!#$%&'*+/=?^_`{|}~-]"
QUOTED = r"[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]"
ESCAPED = r"\\[\x01-\x09\x0b\x0c\x0e-\x7f]"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
TLD = r"\.[a-zA-Z]{2,63}$"

#: Possessive forms, so that no input makes the matcher recurse or start again inside a run of atoms:
#: a local part starts where no atom stands before it, unless the last match ended there.
_LOCAL = rf"(?:(?:\G|(?<!{ATOM})){ATOM}++(?:\.{ATOM}++)*+|\"(?:{QUOTED}++|{ESCAPED})*+\")"
_LABEL = r"[a-zA-Z0-9]++(?:-++[a-zA-Z0-9]++)*+"
_TAGGED = r"[a-zA-Z0-9-]*[a-zA-Z0-9]:(?:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5b\x5e-\x7f]++|\\[\t ]?+)*+\])++"
_LITERAL = rf"\[(?:{OCTET}\.){{3}}(?:{OCTET}\]|{_TAGGED})"
PATTERN = rf"{_LOCAL}@(?:{_LABEL}(?:\.{_LABEL})++|{_LITERAL})"


def candidates(text: Column) -> Column:
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.contains("@"), F.transform(found, lambda m: F.regexp_replace(m, f"^{WHITESPACE}|{WHITESPACE}$", ""))).otherwise(none)


def is_valid(text: Column) -> Column:
    """One @, both sides there, the lengths of local part, domain and labels, and a letters-only top level."""
    parts = F.split(text, "@")
    local, domain = F.element_at(parts, 1), F.element_at(parts, 2)
    labels = F.forall(F.split(domain, r"\."), lambda x: F.length(x) <= 63)
    sized = (F.length(local) > 0) & (F.length(domain) > 0) & (F.length(local) <= 64) & (F.length(domain) <= 253)
    return F.when(F.size(parts) == 2, sized & labels & domain.rlike(TLD)).otherwise(False)


def redact(text: Column, mask: str = "*") -> Column:
    """Keeps 0 of 1, 1 of up to 5, first and last of up to 9, first 3 and last of 10 or more characters of the local part; the domain stays."""
    local = F.substring_index(text, "@", 1)
    n = F.length(local)
    hidden = lambda k: F.repeat(F.lit(mask), n - k)
    first, last = F.substring(local, 1, 1), F.substring(local, -1, 1)
    masked = (
        F.when(n <= 1, F.repeat(F.lit(mask), n))
        .when(n <= 5, F.concat(first, hidden(1)))
        .when(n < 10, F.concat(first, hidden(2), last))
        .otherwise(F.concat(F.substring(local, 1, 3), hidden(4), last))
    )
    return F.when(text.contains("@"), F.concat(masked, F.lit("@"), F.substring_index(text, "@", -1))).otherwise(text)


def find(text: Column, mode: str = "distinct", lookaround: bool = False) -> Column:
    """array<struct<key, value>> of the distinct redacted addresses of a text."""
    values = F.array_distinct(F.transform(F.filter(candidates(text), is_valid), lambda v: redact(v)))
    return F.transform(values, lambda v: F.struct(F.lit("email").alias("key"), v.alias("value")))
