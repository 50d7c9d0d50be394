"""Settings of an analysis, as users write them, and what operators derive from them.

Every setting is a row of one table: the key users write, what kind of value it has, and its default. One reader
turns written values into records; the records are made from the same table. Keys that the table lacks are ignored.
"""

from __future__ import annotations

import ast
import json
import math
import os
from collections.abc import Mapping
from dataclasses import asdict, make_dataclass
from typing import Any, NamedTuple


class Setting(NamedTuple):
    name: str
    key: str
    kind: str
    default: str
    length: int | None = None


#: Keys and defaults as users write them.
TABLE = {
    "bank": (
        Setting("orientations", "N_thetas", "whole", "8"),
        Setting("sizes", "Sigmas", "reals", "[2, 3, 4, 5, 6, 8]"),
        Setting("frequencies", "Frequencies", "reals", "[0.015, 0.04, 0.07, 0.1]"),
        Setting("phases", "Phases", "reals", "[0, 90]"),
        Setting("nx", "NX", "whole", "135"),
        Setting("ny", "NY", "whole", "54"),
        Setting("saved_at", "Save Path", "path", ""),
    ),
    "run": (
        Setting("folders", "Dirs", "paths", "."),
        Setting("experiment", "Experiment Info", "words", "('subject', '2024-01-01', 1)", 3),
        Setting("planes", "Number of Planes", "whole", "1"),
        Setting("first_block_end", "Block End", "whole", "0"),
        Setting("nx", "NX", "whole", "135"),
        Setting("ny", "NY", "whole", "54"),
        Setting("sizes", "Sigmas", "reals", "[2, 3, 4, 5, 6, 8]"),
        Setting("screen", "Visual Coverage", "reals", "[-135, 45, 34, -34]", 4),
        Setting("analysed", "Analysis Coverage", "reals", "[-135, 0, 34, -34]", 4),
        Setting("rate", "Hz", "whole", "30"),
        Setting("frames", "Number of Frames", "whole", "18000"),
        Setting("trials", "Number of Trials to Keep", "whole", "3"),
        Setting("movie", "Movie Path", "path", ""),
        Setting("library", "Library Path", "path", ""),
        Setting("spikes", "Spks Path", "path", "None"),
    ),
}
#: The words for no value, and other names under which files hold the two groups.
NOTHING = ("", "none", "null", "nil")
GROUP_NAMES = {"bank": ("gabor", "gabor_param"), "run": ("analysis", "param_defaults")}

Bank = make_dataclass("Bank", [s.name for s in TABLE["bank"]], frozen=True)
Run = make_dataclass("Run", [s.name for s in TABLE["run"]], frozen=True)
Settings = make_dataclass("Settings", ["bank", "run"], frozen=True)


def value_of(written: Any) -> Any:
    """What a text says: a number, list or tuple, None for the words for nothing, else the text itself."""
    if not isinstance(written, str):
        return written
    if written.strip().lower() in NOTHING:
        return None
    try:
        return ast.literal_eval(written.strip())
    except (ValueError, SyntaxError):
        return written


def read(setting: Setting, written: Any) -> Any:
    """A written value as what its setting asks for; an error names the key."""
    if setting.kind in ("path", "paths"):
        got = value_of(written)
        items = got if isinstance(got, (list, tuple)) else [got]
        paths = tuple(os.path.expandvars(os.path.expanduser(str(p))) for p in map(value_of, items) if p is not None)
        return paths if setting.kind == "paths" else (paths[0] if paths else None)
    got = value_of(written)
    try:
        if setting.kind == "whole":
            if float(got) != int(got):
                raise ValueError
            return int(got)
        items = tuple(got) if isinstance(got, (list, tuple)) else (got,)
        items = tuple(map(str, items)) if setting.kind == "words" else tuple(map(float, items))
    except (TypeError, ValueError) as e:
        raise ValueError(f"{setting.key}: {written!r} cannot be read") from e
    if setting.length not in (None, len(items)):
        raise ValueError(f"{setting.key} needs {setting.length} values, not {len(items)}")
    return items


def settings(bank: Mapping[str, Any] | None = None, run: Mapping[str, Any] | None = None) -> Settings:
    """Records of all settings from what is written of them; the rest has its default."""
    group = lambda kind, name, given: kind(**{s.name: read(s, given.get(s.key, s.default)) for s in TABLE[name]})
    return Settings(group(Bank, "bank", bank or {}), group(Run, "run", run or {}))


def settings_file(path: str, root: str | None = None) -> Settings:
    """Settings from a JSON file in which {PROJECT_ROOT} stands for ``root`` (by default the working directory)."""
    with open(path, encoding="utf-8") as f:
        got = json.loads(f.read().replace("{PROJECT_ROOT}", (root or os.getcwd()).replace("\\", "/")))
    return settings(*(next((got[k] for k in GROUP_NAMES[g] if k in got), None) for g in ("bank", "run")))


def written(group: str, record: Any) -> dict[str, str]:
    """A record as users write it."""
    got = asdict(record)
    return {s.key: str(list(got[s.name]) if s.kind in ("reals", "paths") else got[s.name]) for s in TABLE[group]}


def angles(bank: Bank) -> list[float]:
    return [i * math.pi / bank.orientations for i in range(bank.orientations)]


def offsets(bank: Bank, unit: str = "degrees") -> list[float]:
    """Phases in radians; unit 'raw' passes them on as they are written."""
    return [math.radians(p) if unit == "degrees" else p for p in bank.phases]


def analysed_sizes(run: Run, sizes: tuple[float, ...] | None = None) -> list[float]:
    """Filter sizes in degrees of the analysed part of the screen, cut (not rounded) to two places."""
    per_pixel = abs(run.analysed[1] - run.analysed[0]) / run.nx
    return [math.trunc(2 * per_pixel * s * 100) / 100 for s in sizes or run.sizes]


def analysed_shares(run: Run) -> tuple[float, float]:
    """Which shares of the screen's width and height are analysed."""
    (a, b, c, d), (e, f, g, h) = run.analysed, run.screen
    return abs(a - b) / abs(e - f), abs(c - d) / abs(g - h)


def analysed_pixels(run: Run, rows: int, cols: int) -> tuple[int, int, int, int]:
    """The analysed part of a frame: begin and end of its rows and of its columns."""
    (a, b, c, d), (e, f, g, h) = run.analysed, run.screen
    at = lambda x, lo, hi, n: round((x - lo) / (hi - lo) * n)
    return at(c, g, h, rows), at(d, g, h, rows), at(a, e, f, cols), at(b, e, f, cols)


def experiment_folder(run: Run) -> str:
    return os.path.join(*run.folders[:1], *run.experiment)
