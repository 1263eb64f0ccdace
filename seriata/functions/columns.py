"""Small native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    return F.when(finite(c), c)


def clamped_log(c: Column, floor: float = 1e-12) -> Column:
    return F.ln(F.greatest(c, F.lit(floor)))


def indicator(c: Column) -> Column:
    """1 or 0; undefined counts as 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def token(c: Column) -> Column:
    """A field as it stands in sample ids; null is the word unknown."""
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def joined(*cols: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *cols)


def product_split(product: Column) -> Column:
    """val, test or train by the product's prefix; null for others."""
    s = F.regexp_extract(product, "^(val|test|train)_", 1)
    return F.when(s != "", s)


def product_order(order: Column) -> Column:
    return F.when(order == "index", "dataset_index").when(order == "loader", "loader_emission")


def overlap(a_end: Column, b_start: Column) -> Column:
    """Shared points of two half-open spans, the first of which starts first."""
    return F.greatest(F.lit(0), a_end - b_start)


def ceil_cube_root(n: Column) -> Column:
    """Least integer whose cube is n at least, exact for integers."""
    r = F.round(F.pow(n.cast("double"), F.lit(1.0 / 3.0))).cast("bigint")
    return F.when(r * r * r >= n, F.when((r - 1) * (r - 1) * (r - 1) >= n, r - 1).otherwise(r)).otherwise(r + 1)


def order_key(seed: object, *cols: Column) -> Column:
    """Text that sorts rows into a seeded random order, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def fixed(c: Column, decimals: int, grouped: bool = False) -> Column:
    """A figure as text, rounded half up, with thousands separated on demand."""
    r = F.round(c.cast("double"), decimals)
    return F.format_number(r, decimals) if grouped else F.format_string(f"%.{decimals}f", r)


def wall_clock(text: Column) -> Column:
    """The time a run record names, as a timestamp without zone."""
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def sorted_json(columns: dict[str, Column]) -> Column:
    """One JSON object with its keys in order."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def pipe_list(text: Column) -> Column:
    """The parts of a list written as a|b|c; none for an empty text."""
    return F.filter(F.split(text, r"\|"), lambda x: x != "")


def escape_tex(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def macros(c: Column) -> Column:
    """All \\Num... names in a text."""
    return F.regexp_extract_all(c, F.lit(r"(\\Num[A-Za-z]+)"), F.lit(1))


def stable_seed(*parts: object) -> int:
    """64-bit seed of any key, the same in every process."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(repr, parts)).encode(), digest_size=8).digest(), "big")
