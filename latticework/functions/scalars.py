"""Scalar functions as Column expressions: names, numbers, rects, hashes, text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- numbers


def round_half_up(x: Column) -> Column:
    """Half toward plus infinity (2.5 -> 3, -2.5 -> -2); Spark's round goes away from zero."""
    return F.floor(x + 0.5).cast("long")


def to_byte(x: Column) -> Column:
    """Round half to even, clamped to 0..255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(x))).cast("int")


def fixed5(x: Column) -> Column:
    """A number for text output, five decimals at most."""
    return F.floor(x * 100000 + 0.5) / 100000


def kilobytes(size: Column) -> Column:
    """At least 1; null unless size is positive."""
    return F.when(size > 0, F.greatest(F.lit(1).cast("long"), round_half_up(size / 1024)))


# ---- names and paths


def extension_less(name: Column) -> Column:
    """The part before the last dot, if that dot is not the first character."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def parse_name(name: Column) -> Column:
    """struct<grp, idx>: stem without its trailing number and separators, and that number (or null)."""
    stem = extension_less(name)
    pattern = r"(?s)^(.+?)[_\-\s]?(\d+)$"
    numbered = stem.rlike(pattern)
    head = F.regexp_replace(F.regexp_extract(stem, pattern, 1), r"[_\-\s]+$", "")
    numbered = numbered & (head != "")
    return F.struct(F.when(numbered, head).otherwise(stem).alias("grp"), F.when(numbered, F.regexp_extract(stem, pattern, 2).try_cast("long")).alias("idx"))


def stable_id(source: Column, ordinal: Column, given: Column | None = None) -> Column:
    """source#local: the given id, or `sprite-` and a number of four digits at least."""
    local = F.format_string("sprite-%04d", ordinal.cast("long"))
    return F.concat(source, F.lit("#"), F.coalesce(given, local) if given is not None else local)


def snake(text: Column, keep: str = "a-z0-9") -> Column:
    """Lower case with runs of other characters as one underscore, trimmed; `asset` if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), f"[^{keep}]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("asset"))


def file_base(name: Column) -> Column:
    """A file name without extension, fit for output names."""
    flat = F.lower(F.regexp_replace(extension_less(name), "[^A-Za-z0-9_-]+", "_"))
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("asset"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def join_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), F.regexp_replace(name, "^/+", ""))


def glob_regex(glob: str) -> str:
    """Anchored regex of a glob: `**/` any folders, `**` anything, `*` and `?` within a folder."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(t) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", t) for t in tokens) + "$"


def matches_globs(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(glob_regex(g) for g in globs))
    return any_of(include) & ~any_of(exclude)


# ---- text


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_fence(text: Column) -> Column:
    """JSON text out of a Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def uri_component(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() alone."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cache_key(provider: Column, model: Column, version: Column, digest: Column, name: Column | None = None) -> Column:
    parts = [provider, model, F.concat(F.lit("v"), version.cast("string")), digest]
    return F.concat_ws("/", *parts, *([uri_component(name)] if name is not None else []))


# ---- hashes

#: The public 32-bit FNV-1a offset basis and prime.
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193
_MASK32 = 0xFFFFFFFF


def fnv1a32_codes(codes: Column, seed: int = FNV_BASIS) -> Column:
    """FNV-1a over an array of byte values, as a long in 0..2^32-1."""
    mask = F.lit(_MASK32)
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: ((h.bitwiseXOR(c.cast("long"))) * F.lit(FNV_PRIME)).bitwiseAND(mask))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-16 code units of a string."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    starts = F.sequence(F.lit(0), F.floor(F.length(units) / 4).cast("int") - 1)
    codes = F.transform(starts, lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10))
    return fnv1a32_codes(F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<string>")))


def mulberry32(seed: Column) -> Column:
    """The first number in [0, 1) of the public mulberry32 generator for a seed of 32 bits."""
    low = lambda c: c.bitwiseAND(F.lit(_MASK32))
    # the low half of a product of two 32-bit numbers; one factor goes in halves of 16 bits, so nothing overflows
    times = lambda a, b: low(low(a * F.shiftright(b, 16)) * F.lit(65536) + a * b.bitwiseAND(F.lit(65535)))
    state = low(seed.cast("long") + F.lit(0x6D2B79F5))
    t = times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    t = low(t.bitwiseXOR(low(t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61))))))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity_percent(distance: Column, bits: int = 64) -> Column:
    return round_half_up((1 - distance / bits) * 100)


# ---- geometry


def rect_problems(x: Column, y: Column, w: Column, h: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Array of problems of a rect; bounds are looked at only if the numbers are sound."""
    whole = lambda c: c.isNotNull() & (c == F.floor(c))
    names = (("x", x), ("y", y), ("width", w), ("height", h))
    types = F.filter(F.array(*[F.when(~whole(c), F.lit(f"{n} must be an integer")) for n, c in names]), lambda p: p.isNotNull())
    signs = [F.when(c < 0, F.lit(f"{n} must not be negative")) for n, c in names[:2]] + [F.when(c <= 0, F.lit(f"{n} must be at least 1")) for n, c in names[2:]]
    bounds = []
    if width is not None:
        bounds.append(F.when((x >= 0) & (w > 0) & (x + w > width), F.lit("rect exceeds the width")))
    if height is not None:
        bounds.append(F.when((y >= 0) & (h > 0) & (y + h > height), F.lit("rect exceeds the height")))
    ranges = F.filter(F.array(*signs, *bounds), lambda p: p.isNotNull())
    return F.when(F.size(types) > 0, types).otherwise(ranges)


def pivot_of(mode: Column, x: Column, y: Column) -> Column:
    return F.struct(
        F.when(mode.isin("center", "bottom-center"), F.lit(0.5)).otherwise(x).alias("x"),
        F.when(mode == "center", F.lit(0.5)).when(mode == "bottom-center", F.lit(1.0)).otherwise(y).alias("y"),
    )


#: How far a pivot may be from the middle of the bottom edge.
PIVOT_EPSILON = 0.05


def pivot_deviates(x: Column, y: Column) -> Column:
    return F.hypot(x - 0.5, y - 1.0) > PIVOT_EPSILON


def flip_y(page_height: Column, y: Column, h: Column) -> Column:
    """From a top-left to a bottom-left origin."""
    return page_height - y - h
