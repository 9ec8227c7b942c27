"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: str | Column) -> Column:
    """The number, or 0.0 where it can't be read."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def trimmed_text(c: str) -> Column:
    """Any value as text without blanks at its ends; '' for null."""
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))


def percent_tag(noise: float) -> int:
    """The whole percent that names a noise level."""
    return int(noise * 100)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def number_list(c: str) -> Column:
    """An array of whole numbers from its text form."""
    return F.from_json(c, "array<int>")


def list_text(c: str) -> Column:
    return F.to_json(c)


def is_close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Whether two numbers differ by ``atol`` and ``rtol`` of the second at most."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def binary_text(c: Column, width: int) -> Column:
    """A whole number in binary, with zeros in front up to ``width`` digits; longer ones stay whole."""
    bits = F.bin(c)
    return F.when(F.length(bits) < width, F.lpad(bits, width, "0")).otherwise(bits)


def tiled(array: Column, times: int) -> Column:
    """An array ``times`` times end to end."""
    return F.flatten(F.array_repeat(array, times))


#: The modulus of ``uniform``.
PRIME = 2147483647


def uniform(seed: int, *numbers: Column) -> Column:
    """A number between 0 and 1 that follows from a seed and whole numbers by plain arithmetic."""
    h = F.lit(seed).cast("long")
    for n in numbers:
        h = F.pmod(h * 48271 + F.pmod(n.cast("long"), F.lit(PRIME)), F.lit(PRIME))
    # Squares take the order out; a lambda holds the number, so that it is computed once.
    for _ in range(3):
        h = F.transform(F.array(h), lambda x: F.pmod(x * x + 40692, F.lit(PRIME)))[0]
    return (h + 0.5) / float(PRIME)


def normal(seed: int, *numbers: Column) -> Column:
    """A normal deviate that follows from a seed and whole numbers."""
    return F.sqrt(-2 * F.ln(uniform(2 * seed, *numbers))) * F.cos(2 * F.pi() * uniform(2 * seed + 1, *numbers))


# Classes of road types. In both, a type not named is of class 1.
EIGHT_LEVELS = {"motorway": 8, "trunk": 7, "primary": 6, "secondary": 5, "tertiary": 4, "unclassified": 3, "residential": 2}
LINK_LEVELS = {
    "motorway": 8, "motorway_link": 8,
    "trunk": 7, "trunk_link": 7, "primary": 7, "primary_link": 7, "busway": 7,
    "secondary": 5, "secondary_link": 5,
    "tertiary": 4, "tertiary_link": 4,
    "service": 3,
    "residential": 2,
}


def reclass(c: str | Column, levels: dict[str, int] = EIGHT_LEVELS) -> Column:
    """The class of a road type."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return F.coalesce(F.element_at(table, c), F.lit(1))
