"""Pipeline settings: a document is validated (all problems at once), migrated and filled with defaults."""

from __future__ import annotations

import copy
import json
import math
from dataclasses import dataclass

# Section defaults and ranges of the settings document.
VERSION = 2
DEFAULTS = {
    "input": {"format": "png", "recursive": True, "include": ["**/*.png"], "exclude": ["**/output/**"]},
    "detect": {"mode": "alpha-connected-components", "alphaThreshold": 8, "minPixels": 4, "connectivity": 8},
    "trim": {"enabled": True},
    "resize": {"enabled": False, "mode": "scale", "scale": 1, "filter": "nearest"},
    "padding": {"pixels": 2},
    "bleed": {"pixels": 2},
    "pivot": {"mode": "bottom-center"},
    "atlas": {"maxWidth": 2048, "maxHeight": 2048, "algorithm": "maxrects", "spacing": 2},
    "output": {"format": ["png", "json"], "godot": {"enabled": False}, "unity": {"enabled": False}},
    "quality": {"maxTransparentRatio": 0.6, "duplicateHammingThreshold": 5, "characterPatterns": [], "nonDescriptivePatterns": [r"^img[ _-]?\d+$", r"^(final|new|copy|test|untitled)\d*$", r"^aaa\d*$", r"^bad[_ -]?name"]},
}

# A rule is (kind, arguments). Kinds: int lo hi, number lo hi (lo excluded if open), bool, enum, strings.
_COUNT, _SIZE, _UNIT = ("int", 1, 10_000), ("int", 1, 16_384), ("number", 0, 1)
RULES = {
    "input": {"format": ("enum", "png"), "recursive": ("bool",), "include": ("strings",), "exclude": ("strings",)},
    "detect": {"mode": ("enum", "alpha-connected-components", "grid", "manual"), "alphaThreshold": ("int", 0, 255), "minPixels": ("int", 1, 1_000_000), "connectivity": ("enum", 4, 8), "rows": _COUNT, "columns": _COUNT, "cellWidth": _SIZE, "cellHeight": _SIZE, "rects": ("rects",)},
    "trim": {"enabled": ("bool",), "alphaThreshold": ("int", 0, 255)},
    "resize": {"enabled": ("bool",), "mode": ("enum", "scale"), "scale": ("number", 2.220446049250313e-16, 64), "filter": ("enum", "nearest", "bilinear")},
    "padding": {"pixels": ("int", 0, 64)},
    "bleed": {"pixels": ("int", 0, 64)},
    "pivot": {"mode": ("enum", "center", "bottom-center", "manual"), "x": _UNIT, "y": _UNIT},
    "atlas": {"maxWidth": _SIZE, "maxHeight": _SIZE, "algorithm": ("enum", "maxrects"), "spacing": ("int", 0, 128)},
    "output": {"format": ("formats",), "godot": ("switch",), "unity": ("switch",)},
    "quality": {"maxTransparentRatio": _UNIT, "duplicateHammingThreshold": ("int", 0, 64), "characterPatterns": ("strings",), "nonDescriptivePatterns": ("strings",)},
}
REQUIRED = {"detect": ("mode",), "pivot": ("mode",)}


@dataclass(frozen=True)
class Problem:
    path: str
    message: str
    code: str


class ConfigError(ValueError):
    def __init__(self, problems: list[Problem]):
        super().__init__("; ".join(f"{p.path}: {p.message}" for p in problems))
        self.problems = problems


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _wrong(value, rule: tuple) -> str | None:
    """What is wrong with a value, or None."""
    kind, args = rule[0], rule[1:]
    if kind == "int":
        return None if _whole(value) and args[0] <= value <= args[1] else f"must be an integer in [{args[0]}, {args[1]}]"
    if kind == "number":
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and args[0] <= value <= args[1]
        return None if good else f"must be a number in [{args[0]:g}, {args[1]:g}]"
    if kind == "bool":
        return None if isinstance(value, bool) else "must be true or false"
    if kind == "enum":
        return None if value in args and not isinstance(value, bool) else f"must be one of {', '.join(map(str, args))}"
    if kind == "strings":
        return None if isinstance(value, list) and all(isinstance(v, str) and v for v in value) else "must be an array of non-empty strings"
    if kind == "formats":
        good = isinstance(value, list) and value and all(v in ("png", "json") for v in value) and len(set(value)) == len(value)
        return None if good else "must be distinct formats out of png, json"
    if kind == "switch":
        return None if isinstance(value, dict) and set(value) <= {"enabled"} and isinstance(value.get("enabled", False), bool) else "must be an object with enabled"
    if kind == "rects":
        keys = ("x", "y", "width", "height")
        good = isinstance(value, list) and value and all(isinstance(r, dict) and set(r) <= {*keys, "id"} and all(_whole(r.get(k)) for k in keys) and min(r["x"], r["y"]) >= 0 and min(r["width"], r["height"]) >= 1 and isinstance(r.get("id", "-"), str) and r.get("id", "-") for r in value)
        return None if good else "must be a non-empty array of rects"
    raise AssertionError(kind)


def problems_of(doc) -> list[Problem]:
    """All problems of a document, in the order of its sections."""
    if not isinstance(doc, dict):
        return [Problem("$", "preset must be a JSON object", "PRESET_MALFORMED")]
    out = [Problem(f"$.{k}", f"unknown key (allowed: schemaVersion, {', '.join(RULES)})", "PRESET_UNKNOWN_KEY") for k in doc if k not in RULES and k != "schemaVersion"]
    version = doc.get("schemaVersion")
    if not _whole(version) or version < 1:
        out.append(Problem("schemaVersion", "must be a positive integer", "PRESET_INVALID_VALUE"))
    elif version > VERSION:
        out.append(Problem("schemaVersion", f"version {version} is not supported (at most {VERSION})", "PRESET_SCHEMA_VERSION_UNSUPPORTED"))
    for section, rules in RULES.items():
        if section not in doc:
            continue
        body = doc[section]
        if not isinstance(body, dict):
            out.append(Problem(section, "must be an object", "PRESET_INVALID_VALUE"))
            continue
        out += [Problem(f"{section}.{k}", f"unknown key (allowed: {', '.join(rules)})", "PRESET_UNKNOWN_KEY") for k in body if k not in rules]
        needed = [k for k in REQUIRED.get(section, ()) if k not in body]
        out += [Problem(f"{section}.{k}", "is required", "PRESET_INVALID_VALUE") for k in needed]
        out += [Problem(f"{section}.{k}", w, "PRESET_INVALID_VALUE") for k, rule in rules.items() if k in body and (w := _wrong(body[k], rule))]
        out += [Problem(section, m, "PRESET_INVALID_VALUE") for m in _together(section, body)]
    return out


def _together(section: str, body: dict) -> list[str]:
    """Conditions over several keys of a section."""
    if section == "detect" and body.get("mode") == "grid":
        count, size = {"rows", "columns"} & set(body), {"cellWidth", "cellHeight"} & set(body)
        if count and size:
            return ["grid takes rows and columns, or a cell size, not both"]
        if not count and not size:
            return ["grid needs rows and columns, or a cell size"]
    if section == "detect" and body.get("mode") == "manual" and "rects" not in body:
        return ["manual needs rects"]
    if section == "pivot" and body.get("mode") == "manual" and not {"x", "y"} <= set(body):
        return ["manual needs x and y"]
    return []


def migrate(doc: dict) -> dict:
    """The document in the current version; version 2 only added the optional quality section."""
    return doc | {"schemaVersion": VERSION}


@dataclass(frozen=True)
class Config:
    input: dict
    detect: dict
    trim: dict
    resize: dict
    padding: dict
    bleed: dict
    pivot: dict
    atlas: dict
    output: dict
    quality: dict

    @classmethod
    def parse(cls, doc) -> Config:
        if isinstance(doc, (str, bytes)):
            try:
                doc = json.loads(doc)
            except ValueError as e:
                raise ConfigError([Problem("$", f"not JSON: {e}", "PRESET_MALFORMED")]) from e
        if found := problems_of(doc):
            raise ConfigError(found)
        doc = migrate(doc)
        filled = {s: copy.deepcopy(DEFAULTS[s]) | copy.deepcopy(doc.get(s, {})) for s in RULES}
        detect = filled["detect"]
        if detect["mode"] == "manual":
            filled["detect"] = {"mode": "manual", "rects": detect["rects"]}
        elif detect["mode"] == "grid":
            filled["detect"] = {k: detect[k] for k in ("mode", "rows", "columns", "cellWidth", "cellHeight", "alphaThreshold") if k in detect}
        else:
            filled["detect"] = {k: detect[k] for k in ("mode", "alphaThreshold", "minPixels", "connectivity")}
        filled["trim"].setdefault("alphaThreshold", filled["detect"].get("alphaThreshold", DEFAULTS["detect"]["alphaThreshold"]))
        if filled["pivot"]["mode"] != "manual":
            filled["pivot"] = {"mode": filled["pivot"]["mode"]}
        return cls(**filled)

    @classmethod
    def default(cls) -> Config:
        return cls.parse({"schemaVersion": VERSION})

    def to_json(self) -> str:
        """Stable key order; the normalised form is marked version 1."""
        return json.dumps({"schemaVersion": 1, **{s: getattr(self, s) for s in RULES}}, indent=2) + "\n"
