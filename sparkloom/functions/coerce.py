"""Column functions: casts, identifiers, hashes and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\r\\n]+"


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))


# The spelt-out states.
YES, NO = ("true", "yes", "resolved", "verified", "1"), ("false", "no", "unresolved", "-1", "0")
MORE_YES, MORE_NO = ("1", "true", "yes", "y", "resolved", "verified", "pass", "passed"), ("0", "false", "no", "n", "unresolved", "fail", "failed", "")


def _states(value: Column, kind: str, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    if kind == "boolean":
        return value.cast("boolean")
    if kind != "string":
        return value > 0
    t = F.lower(F.trim(value))
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def tri_state(value: Column, kind: str = "string") -> Column:
    """Boolean of the spelt-out states of a text, or of a number above 0; other texts are unknown. kind: the column's type."""
    return _states(value, kind, YES, NO)


def lenient_tri_state(value: Column, kind: str = "string") -> Column:
    """As tri_state, with y, pass and passed, n, fail, failed and the empty text, and without -1."""
    return _states(value, kind, MORE_YES, MORE_NO)


def safe_number(value: Column, kind: str, to: str = "double") -> Column:
    """A number or the number in a text; booleans and what is no number are null."""
    if kind == "boolean":
        return F.lit(None).cast(to)
    n = value.try_cast("double")
    return n if to == "double" else F.when(~F.isnan(n) & (F.abs(n) < 9.2e18), n.cast(to))


def source_of(sample: Column) -> Column:
    """What stands before /data/ in a sample id, else before its first colon."""
    return F.when(sample.contains("/data/"), F.substring_index(sample, "/data/", 1)).otherwise(F.substring_index(sample, ":", 1))


def first_filled(*values: Column) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(v.cast("string")) != "", v) for v in values])


def slug(text: Column) -> Column:
    """Lower case, runs of other than a-z, 0-9, dot, underscore and hyphen as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def roman(number: Column) -> Column:
    """Roman numeral of 1 to 3999, null outside."""
    # fixed values: the numerals
    steps = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    left, parts = number.cast("int"), []
    for size, mark in steps:
        parts.append(F.repeat(F.lit(mark), F.floor(left / size).cast("int")))
        left = left % size
    return F.when(number.between(1, 3999), F.concat(*parts))


def revision(uri: Column) -> Column:
    """What follows the last @ of a model URI, null without one."""
    return F.nullif(F.regexp_extract(uri, "@([^@/]+)$", 1), F.lit(""))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON text with sorted keys; null fields are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def stamp(at: Column) -> Column:
    """20260102T030405Z of a timestamp in a UTC session."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def success(*signals: Column) -> Column:
    """True if any is true, else false if any is false, else null."""
    some = lambda v: F.coalesce(F.greatest(*[(s == F.lit(v)).cast("int") for s in signals]), F.lit(0)) == 1
    return F.when(some(True), True).when(some(False), False)


def sample_id(value: Column) -> dict[str, Column]:
    """shard, row, turn and replica of shard:row:turn#rN; null where it is not one."""
    base = F.regexp_replace(value, "#r\\d+$", "")
    part = lambda k: F.nullif(F.regexp_extract(base, "^(.*):(-?\\d+):(-?\\d+)$", k), F.lit(""))
    return {"base": base, "shard": part(1), "row": part(2).cast("long"), "turn": part(3).cast("long"), "replica": F.coalesce(F.nullif(F.regexp_extract(value, "#r(\\d+)$", 1), F.lit("")).cast("int"), F.lit(1))}


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def unit_hash(key: Column) -> Column:
    """The first 64 bits of the key's SHA-256 as a double in [0, 1)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_mod(key: Column, n: int) -> Column:
    """The first 32 bits of the key's SHA-256 modulo n."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n


def tokens_of_length(chars: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((chars + 3) / 4)


def excerpt(text: Column, most: int = 240) -> Column:
    t = squeezed(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def family(instance: Column) -> Column:
    tail = F.substring_index(instance, ".", -1)
    return F.when(tail.startswith("pr_") | ~instance.contains("."), "pr").when(tail.startswith("lm_"), "lm").when(tail.startswith("combine"), "combine").otherwise("mechanical")
