"""Text expressions. `(?U)` makes `\\s` and `\\d` cover the whole of Unicode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Unit types that mark a combined-cycle unit.
CC_TYPES = ("CC", "복합")


def strip(c: Column) -> Column:
    """Strip every kind of white space at both ends; `trim` knows only the space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    """Null becomes '', ends are stripped and inner runs of white space become one space."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(~c.isin("", " "), c)


def cc_group(name: Column, unit_type: Column) -> Column:
    """Group a combined-cycle unit belongs to: its name without a trailing GT/ST marker."""
    text = strip(name)

    def cut(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    found = F.coalesce(
        cut(r"(?U)^(.+)\s+(?:GT|ST)_\d+$"),
        cut(r"(?U)^(.+)\s+(?:GT|ST)\s+\d+$"),
        cut(r"^(.*) (?:GT|ST)$"),
    )
    return F.when(strip(unit_type).isin(*CC_TYPES), found)


def joined_name(columns: Sequence[str | Column], sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def edge_label(bus0: Column, bus1: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), bus0, F.lit(" → "), bus1)


def voltage_number(c: Column) -> Column:
    """First run of digits, as a number."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("double")


def voltage_text(c: Column, default: float = 220.0) -> Column:
    """'154 kV' and '154' alike; anything else is the default."""
    return F.coalesce(strip(F.replace(c.cast("string"), F.lit("kV"), F.lit(""))).try_cast("double"), F.lit(default))


def address_parts(address: Column) -> Column:
    """Words of an address before any bracket."""
    cleaned = strip(F.split_part(address, F.lit("("), F.lit(1)))
    return F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: w != "")


def address_candidates(address: Column) -> Column:
    """Look-up texts of an address in order of preference, as (priority, text).

    All words first, then one word fewer each time down to two; at every step the text itself and,
    if it names a county, the same text read as a city.
    """
    parts = address_parts(address)
    size = F.size(parts)
    texts = F.transform(
        F.when(size >= 2, F.sequence(size, F.lit(2), F.lit(-1))),
        lambda n: F.array_join(F.slice(parts, 1, n), " "),
    )
    pairs = F.flatten(
        F.transform(
            texts,
            lambda text, i: F.array(
                F.struct((i * 2 + 1).alias("priority"), text.alias("text")),
                F.struct(
                    (i * 2 + 2).alias("priority"),
                    F.when(F.contains(text, F.lit("군")), F.replace(text, F.lit("군"), F.lit("시"))).alias("text"),
                ),
            ),
        )
    )
    known = F.array(F.struct(F.lit(0).alias("priority"), address.alias("text")))
    return F.filter(F.concat(known, F.coalesce(pairs, F.slice(known, 1, 0))), lambda p: p["text"].isNotNull())
