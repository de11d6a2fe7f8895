"""Luhn and Verhoeff checksums over the digits of a string, as native expressions and in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _reversed_digits(value: Column) -> Column:
    return F.transform(F.split(F.reverse(digits(value)), ""), lambda c: c.cast("int"))


def luhn_valid(value: Column) -> Column:
    """Whether the digits pass the Luhn check; false without digits."""
    doubled = F.transform(_reversed_digits(value), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return (F.length(digits(value)) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def _dihedral(j: int, k: int) -> int:
    """Product in the symmetry group of the pentagon: 0 to 4 are turns, 5 to 9 turns of the mirrored pentagon."""
    if j < 5:
        return (j + k) % 5 if k < 5 else 5 + (j + k) % 5
    return 5 + (j - k) % 5 if k < 5 else (j - k) % 5


#: The permutation that digits go through once for each place from the right. Fixed values.
PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _permuted(times: int) -> list[int]:
    out = list(range(10))
    for _ in range(times):
        out = [PERMUTATION[x] for x in out]
    return out


PRODUCT = [_dihedral(j, k) for j in range(10) for k in range(10)]
POWERS = [x for times in range(8) for x in _permuted(times)]


def verhoeff_valid(value: Column) -> Column:
    """Whether the digits pass the Verhoeff check; false without digits."""
    product, powers = F.array(*map(F.lit, PRODUCT)), F.array(*map(F.lit, POWERS))
    placed = F.transform(_reversed_digits(value), lambda d, i: F.get(powers, (i % 8) * 10 + F.coalesce(d, F.lit(0))))
    return (F.length(digits(value)) > 0) & (F.aggregate(placed, F.lit(0), lambda c, d: F.get(product, c * 10 + d)) == 0)


def luhn(value: str) -> bool:
    ds = [int(c) for c in reversed(value) if c.isdigit()]
    return bool(ds) and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(ds)) % 10 == 0


def verhoeff(value: str) -> bool:
    ds = [int(c) for c in reversed(value) if c.isdigit()]
    check = 0
    for i, d in enumerate(ds):
        check = PRODUCT[check * 10 + POWERS[i % 8 * 10 + d]]
    return bool(ds) and check == 0
