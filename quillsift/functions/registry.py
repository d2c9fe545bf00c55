"""Detectors by name. A detector is a function from a text Column to array<struct<key: string, value: string>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import email, pan

Detector = Callable[..., Column]

_DETECTORS: dict[str, tuple[str, Detector]] = {m.NAME: (m.DATATYPE, m.find) for m in (pan, email)}


def register(name: str, datatype: str, find: Detector) -> None:
    """Adds a detector; `find` takes (text, mode=, lookaround=) and may be built on a pandas UDF."""
    _DETECTORS[name] = (datatype, find)


def unregister(name: str) -> None:
    _DETECTORS.pop(name, None)


def supported() -> list[str]:
    return list(_DETECTORS)


def takes_pieces(names: list[str] | None = None, mode: str = "distinct") -> bool:
    """True if the detectors named find the same values in pieces (readers.cut) as in whole blocks: this package's own, which keep all distinct values."""
    own = {m.NAME: m.find for m in (pan, email)}
    return mode == "distinct" and all(n in own and _DETECTORS[n][1] is own[n] for n in (supported() if names is None else names))


def detect(text: Column, names: list[str] | None = None, mode: str = "distinct", lookaround: bool = False) -> Column:
    """array<struct<datatype, key, value>> of all detectors named, in one projection over the text."""

    def of(name: str) -> Column:
        datatype, find = _DETECTORS[name]
        return F.transform(find(text, mode=mode, lookaround=lookaround), lambda m: F.struct(F.lit(datatype).alias("datatype"), m["key"].alias("key"), m["value"].alias("value")))

    parts = [of(name) for name in (supported() if names is None else names)]
    return F.concat(*parts) if parts else F.array().cast("array<struct<datatype: string, key: string, value: string>>")
