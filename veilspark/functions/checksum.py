"""Verhoeff check digits. The tables follow from their definition: products in the dihedral group of a pentagon, and
powers of one permutation of the digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: where the scheme's permutation sends the digits 0 to 9.
PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _product(a: int, b: int) -> int:
    """Digits 0-4 turn the pentagon, 5-9 turn and flip it."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


PRODUCTS = [_product(a, b) for a in range(10) for b in range(10)]


def _powers() -> list[int]:
    row, out = list(range(10)), []
    for _ in range(8):
        out.extend(row)
        row = [PERMUTATION[x] for x in row]
    return out


POWERS = _powers()


def verhoeff_ok(number: Column) -> Column:
    """Whether a string of digits ends in its right check digit."""
    products, powers = (F.array(*(F.lit(x) for x in t)) for t in (PRODUCTS, POWERS))
    places = F.sequence(F.lit(0), F.length(number) - 1)
    back = F.reverse(number)
    digit = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    check = F.aggregate(places, F.lit(0), lambda c, i: F.get(products, c * 10 + F.get(powers, (i % 8) * 10 + digit(i))))
    return check == 0


def verhoeff_ok_py(number: str) -> bool:
    c = 0
    for i, ch in enumerate(reversed(number)):
        c = PRODUCTS[c * 10 + POWERS[(i % 8) * 10 + int(ch)]]
    return c == 0
