"""Configuration of a scan: a dataclass on the driver, read from TOML."""

from __future__ import annotations

import datetime
import os
import platform
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from .functions import registry
from .operators import selection

# The default configuration.
DEFAULTS: dict = {
    "dataHandlers": ["pan", "email"],
    "localFilesOnly": True,
    "results": {"path": "scan-results/", "csv": True, "json": True, "text": True},
    "includeFiles": {"ext": "all", "mime": "all", "startDirs": {"windows": "all", "linux": ["/"], "darwin": ["/"]}},
    "excludeDirs": {
        "windows": ["C:\\Windows", "C:\\Program Files (x86)", "C:\\Program Files"],
        "linux": "/boot /dev /etc /proc /run /snap /sys /usr/bin /usr/lib /usr/lib32 /usr/lib64 /usr/libx32 /usr/local /usr/sbin /usr/share /usr/src/ */.vscode-server /mnt/c /mnt/d /mnt/wslg /wsl".split(),
        "darwin": "/dev /etc /usr/bin /usr/local/Homebrew /usr/lib /usr/sbin /Applications /Library/Developer /Library/Documentation /System".split(),
    },
    "logging": {"logLevel": "INFO", "logFile": "logs/scan.log"},
}


@dataclass(frozen=True)
class ScanConfig:
    start_dirs: list[str]
    exclude_dirs: list[str] = field(default_factory=list)
    detectors: list[str] = field(default_factory=registry.supported)
    extensions: list[str] = field(default_factory=lambda: selection.supported("ext"))
    mimes: list[str] = field(default_factory=lambda: selection.supported("mime"))
    results: dict[str, str] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    ignore_case: bool = False
    hidden: bool = False
    mode: str = "distinct"
    lookaround: bool = False


def is_all(value) -> bool:
    """'all' in any case, alone, as the first of a list, or as the first key of a table."""
    if isinstance(value, (list, tuple, dict)):
        value = next(iter(value), "")
    return isinstance(value, str) and value.lower() == "all"


def system() -> str:
    return platform.system().lower()


def _known(values, known: list[str], ignored: list[str]) -> list[str]:
    """The known ones of the values; the rest is told in `ignored`."""
    if is_all(values):
        return list(known)
    ignored += [v for v in values if v not in known]
    return [v for v in values if v in known]


def resolve(raw: dict, root: str | None = None, os_name: str | None = None, now: datetime.datetime | None = None) -> ScanConfig:
    """A table of settings as a ScanConfig; results and logs are kept out of the scan."""
    root, os_name = Path(root or os.getcwd()).absolute(), os_name or system()
    stamp = f"{platform.node()}-{(now or datetime.datetime.now()):%Y%m%d-%H%M%S}"
    ignored: list[str] = []
    out = raw["results"]["path"].rstrip("/") + "/"
    kinds = {"csv": ".csv", "json": ".json", "text": ".txt"}
    include = raw["includeFiles"]
    exts = include["ext"] if is_all(include["ext"]) else [e if e.startswith(".") else f".{e}" for e in include["ext"]]
    starts = include["startDirs"][os_name]
    if is_all(starts):
        starts = [f"{c}:\\" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if os.path.exists(f"{c}:")] if os_name == "windows" else ["/"]
    return ScanConfig(
        start_dirs=list(starts),
        exclude_dirs=[*raw["excludeDirs"][os_name], str(root / out), str((root / raw["logging"]["logFile"]).parent)],
        detectors=_known(raw["dataHandlers"], registry.supported(), ignored),
        extensions=_known(exts, selection.supported("ext"), ignored),
        mimes=_known(include["mime"], selection.supported("mime"), ignored),
        results={k: f"{out}{stamp}{ext}" for k, ext in kinds.items() if raw["results"].get(k)},
        ignored=ignored,
    )


def load(path: str | None = None, **changes) -> ScanConfig:
    """The configuration of a TOML file; the default one if there is no such file."""
    raw = DEFAULTS
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    return replace(resolve(raw), **changes)


def _toml(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def write_default(path: str) -> str:
    """Writes the default configuration; 'Success' or what went wrong."""
    lines: list[str] = []

    def put(table: dict, name: str = "") -> None:
        if name:
            lines.append(f"\n[{name}]")
        lines.extend(f"{k} = {_toml(v)}" for k, v in table.items() if not isinstance(v, dict))
        for k, v in table.items():
            if isinstance(v, dict):
                put(v, f"{name}.{k}" if name else k)

    put(DEFAULTS)
    try:
        Path(path).write_text("\n".join(lines) + "\n")
    except OSError as e:
        return str(e)
    return "Success"
