"""Scalar expressions of the library: hashes, identifiers, path and date rules, vector arithmetic."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

SHA256, ASSET_ID, RUN_ID = r"^[0-9a-f]{64}$", r"^asset-[0-9]{6,}$", r"^[a-z0-9][a-z0-9._-]{0,127}$"


def selection_digest(namespace: str, seed: int, key: Column) -> Column:
    """SHA-256 of namespace:seed:key, the seeded order of a selection."""
    return F.sha2(F.concat(F.lit(f"{namespace}:{seed}:"), key.cast("string")), 256)


def record_id(category: Column, path: Column) -> Column:
    """Category and the first 16 hex digits of the path's SHA-256."""
    return F.concat(category.cast("string"), F.lit("-"), F.substring(F.sha2(path.cast("string"), 256), 1, 16))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a string column as hex, from two hashes over padded key blocks."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def asset_id(index: Column) -> Column:
    return F.format_string("asset-%06d", index.cast("long"))


def asset_index(name: Column) -> Column:
    """The number of an asset id, null for anything else."""
    return F.when(name.rlike(ASSET_ID), F.regexp_extract(name, r"^asset-([0-9]+)$", 1).cast("long"))


def safe_relative_path(path: Column, strict: bool = False) -> Column:
    """Whether a path is relative and stays inside its root: no empty, `.` or `..` part and no backslash; strict also bans
    colons and NUL. Null is not safe."""
    banned = r"[\\:\x00]" if strict else r"\\"
    return F.coalesce(F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", "..")) & ~path.rlike(banned), F.lit(False))


def in_category(category: Column, wanted: str) -> Column:
    """Whether a row is of a category, by its name; null is not."""
    return F.coalesce(category == wanted, F.lit(False))


def under_category(category: Column, path: Column) -> Column:
    """Whether a path lies in its category's folder; null is not."""
    return F.coalesce(F.startswith(path, F.concat(category, F.lit("/"))), F.lit(False))


#: What full case folding makes of characters that lower case leaves as they are, by Unicode's own rule.
FOLDS = {c: c.casefold() for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if c.lower() == c != c.casefold()}


def folded(text: Column) -> Column:
    """A text under full case folding: lower case, and what that leaves apart, such as a sharp s, a final sigma and ligatures."""
    single = {c: f for c, f in FOLDS.items() if len(f) == 1}
    several = F.from_json(F.lit(json.dumps({c: f for c, f in FOLDS.items() if len(f) > 1})), "map<string, string>")
    even = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    spelt = F.array_join(F.transform(F.split(even, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(spelt)


def canonical_date(text: Column) -> Column:
    """Whether a text is an ISO date in its one canonical form."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))


def canonical_name(name: Column) -> Column:
    """Lower case with each run of `-`, `_` and `.` as one hyphen."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object; arrays, numbers, texts that don't parse and null are not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def same_json(a: Column, b: Column) -> Column:
    """Whether two texts are the same JSON value, whatever their spacing and the order of their keys."""
    canonical = lambda c: F.to_json(F.try_parse_json(c))  # noqa: E731  a variant keeps its keys in order
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def short_text(text: Column, most: int = 500) -> Column:
    """Whether a text is trimmed and says something within `most` characters."""
    return F.coalesce((F.trim(text) == text) & F.length(text).between(1, most), F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column, epsilon: float = 1e-12) -> Column:
    """The vector over its length, which counts as epsilon at least."""
    doubles = vector.cast("array<double>")
    length = F.greatest(F.sqrt(dot(doubles, doubles)), F.lit(epsilon))
    return F.transform(F.array(length), lambda n: F.transform(doubles, lambda x: x / n))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of unit vectors, kept within 0 and 2."""
    return F.least(F.greatest(F.lit(1.0) - dot(a, b), F.lit(0.0)), F.lit(2.0))


def top_fraction_count(n: Column, fraction: float, rounding: str) -> Column:
    """How many values the top fraction of n has, at least one; rounding is `ceil` or `floor`."""
    product = n.cast("double") * F.lit(float(fraction))
    return F.greatest(F.lit(1), (F.ceil(product) if rounding == "ceil" else F.floor(product)).cast("int"))


def top_fraction_mean(values: Column, fraction: float, rounding: str = "ceil") -> Column:
    """The mean of the largest fraction of an array."""
    k = top_fraction_count(F.size(values), fraction, rounding)
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), k)
    return F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / k


def any_code(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for holds, code in reversed(rules):
        out = F.when(holds, F.lit(code)).otherwise(out)
    return out
