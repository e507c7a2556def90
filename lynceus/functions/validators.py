"""Check digits and shapes of identifiers, as boolean columns over one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the published checksums.
_INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
_INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
_INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
_IMO = (7, 6, 5, 4, 3, 2)


def _digit(x: Column, i: int) -> Column:
    return F.ascii(F.substring(x, i, 1)) - 48


def _weighted(x: Column, weights: tuple[int, ...], first: int = 1) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + _digit(x, first + i) * w
    return out


def ogrn(x: Column) -> Column:
    """13 digits, the first twelve modulo 11 modulo 10 the last."""
    body = F.expr("0L") + F.coalesce(F.substring(x, 1, 12).try_cast("long"), F.lit(0))
    return F.when(x.rlike(r"^[0-9]{13}\z"), body % 11 % 10 == _digit(x, 13)).otherwise(False)


def inn(x: Column) -> Column:
    """10 digits with one check digit, or 12 with two."""
    ten = _weighted(x, _INN10) % 11 % 10 == _digit(x, 10)
    twelve = (_weighted(x, _INN11) % 11 % 10 == _digit(x, 11)) & (_weighted(x, _INN12) % 11 % 10 == _digit(x, 12))
    return F.when(x.rlike(r"^[0-9]{10}\z"), ten).when(x.rlike(r"^[0-9]{12}\z"), twelve).otherwise(False)


def imo_mmsi(x: Column) -> Column:
    """IMO, in any case, and seven digits with a check digit, or nine digits."""
    return F.when(x.rlike(r"^(?i:IMO)[0-9]{7}\z"), _weighted(x, _IMO, 4) % 10 == _digit(x, 10)).otherwise(x.rlike(r"^[0-9]{9}\z"))


def bic(x: Column) -> Column:
    """Six letters, two letters or digits, and three more or none."""
    return x.rlike(r"^[A-Za-z]{6}[A-Za-z0-9]{2}([A-Za-z0-9]{3})?\z")


def _as_digits(x: Column) -> Column:
    """Letters as two digits, A = 10 to Z = 35."""
    return F.array_join(F.transform(F.split(F.upper(x), ""), lambda c: F.when(c.rlike(r"^[A-Z]\z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def isin(x: Column) -> Column:
    """Two letters, nine letters or digits and a Luhn digit over letters as numbers."""
    return F.when(x.rlike(r"^[A-Za-z]{2}[A-Za-z0-9]{9}[0-9]\z"), F.call_function("luhn_check", _as_digits(x))).otherwise(False)


def mod97(x: Column, length: int) -> Column:
    """Capital letters as numbers, A = 10 to Z = 35, and digits, the whole modulo 97; `length` characters."""
    out = F.lit(0)
    for i in range(1, length + 1):
        c = F.ascii(F.substring(x, i, 1))
        out = (out * F.when(c < 58, 10).otherwise(100) + c - F.when(c < 58, 48).otherwise(55)) % 97
    return out


def lei(x: Column) -> Column:
    """20 letters and digits, ISO 17442: letters as numbers, the whole modulo 97 is 1."""
    return F.when(x.rlike(r"^[A-Z0-9]{18}[0-9]{2}\z"), mod97(x, 20) == 1).otherwise(False)
