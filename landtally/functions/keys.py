"""Canonical identities: SHA-256 of spaced JSON lists, and the splits drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPLITS = ("train", "validation", "test")


def quoted(col: Column) -> Column:
    """One JSON string literal in ASCII; NULL stays NULL and becomes ``null`` in a list.

    Signs, control characters and everything beyond ASCII are escaped as JSON writers do: short escapes where
    there are any, else the UTF-16 units of the character in lower-case hexadecimal digits.
    """
    text = col.cast("string")
    short = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def escaped(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        long = F.regexp_replace(units, "(.{4})", r"\\u$1")
        out = F.when(char.rlike(r"^[\x20-\x7e]$"), char).otherwise(long)
        for plain, code in short.items():
            out = F.when(char == plain, code).otherwise(out)
        return out

    parts = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    safe = text.rlike(r"^[\x20\x21\x23-\x5b\x5d-\x7e]*$")
    return F.concat(F.lit('"'), F.when(safe, text).otherwise(F.array_join(F.transform(parts, escaped), "")), F.lit('"'))


def canonical_list(*parts: Column | int) -> Column:
    """``[a, b]`` with one space after each comma; integers are bare, strings need ``quoted``, NULL is ``null``."""
    columns = [F.lit(str(p)) if isinstance(p, int) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.concat(F.lit("["), F.concat_ws(", ", *columns), F.lit("]"))


def fingerprint(*parts: Column | int) -> Column:
    return F.sha2(canonical_list(*parts), 256)


def short_id(*parts: Column | int) -> Column:
    return F.substring(fingerprint(*parts), 1, 24)


def hash_rank(seed: int, *parts: Column) -> Column:
    """Uniform, reproducible tie order."""
    return fingerprint(seed, *parts)


def hash_bucket(hashed: Column, digits: int = 4) -> Column:
    """Leading hex digits of a hash: a uniform bucket number that grows with the hash."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")


def hash_unit(hashed: Column) -> Column:
    """A value in (0, 1] from the first thirteen hex digits, as many as a double holds."""
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + F.lit(1.0)) / F.lit(4503599627370496.0)


def hash_percent(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") % 100


def split_of_percent(percent: Column) -> Column:
    """70 / 15 / 15."""
    return (F.when(percent < 70, "train").when(percent < 85, "validation").otherwise("test"))


def geographic_block(lon: Column, lat: Column, degrees: int = 5) -> Column:
    return F.concat_ws(
        ":",
        F.floor((lon + 180) / degrees).cast("string"),
        F.floor((lat + 90) / degrees).cast("string"),
    )


def signed_block(lon: Column, lat: Column, degrees: int = 5) -> Column:
    """The block label used by diagnostics: floors of the signed coordinates."""
    return F.concat_ws(
        "_", F.floor(lon / degrees).cast("string"), F.floor(lat / degrees).cast("string")
    )


def geographic_split(lon: Column, lat: Column, seed: int) -> Column:
    hashed = fingerprint(seed, quoted(geographic_block(lon, lat)))
    return split_of_percent(hash_percent(hashed))


def inside_split_block(lon: Column, lat: Column, margin_m: float = 35000.0) -> Column:
    """At least ``margin_m`` from every edge of the 5-degree block."""
    def edge(shifted: Column) -> Column:
        within = F.pmod(shifted, F.lit(5.0))
        return F.least(within, F.lit(5.0) - within) * F.lit(111320.0)
    dx = edge(lon + 180) * F.cos(F.radians(lat))
    return F.least(dx, edge(lat + 90)) >= margin_m
