"""Arithmetic over columns that yields a value or an error, never a wrong number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Checked:
    """A value column with the checks it must pass; combine with + - * / **.

    The value is plain column arithmetic.  The checks are a list, first failure
    first, so the expression grows with the formula and not with its nesting.
    """

    def __init__(self, value: Column, checks: tuple[Column, ...] = ()):
        self.value = value.cast("double")
        self.checks = checks

    @property
    def error(self) -> Column:
        value = self.value
        range_check = F.when(F.isnan(value) | F.abs(value).isin(float("inf")),
                             "result out of range")
        return F.coalesce(*self.checks, range_check)

    @staticmethod
    def of(term) -> "Checked":
        if isinstance(term, Checked):
            return term
        if isinstance(term, (int, float)) and not isinstance(term, bool):
            return Checked(F.lit(float(term)))
        raise TypeError(f"unsupported expression element {term!r}")

    def _combine(self, other, make, check=None) -> "Checked":
        other = Checked.of(other)
        checks = self.checks + other.checks
        value = make(self.value, other.value)
        if check is not None:
            checks += (check(self.value, other.value, value),)
        return Checked(value, checks)

    def __add__(self, other):
        return self._combine(other, lambda a, b: a + b)

    def __radd__(self, other):
        return Checked.of(other) + self

    def __sub__(self, other):
        return self._combine(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return Checked.of(other) - self

    def __mul__(self, other):
        return self._combine(other, lambda a, b: a * b)

    def __rmul__(self, other):
        return Checked.of(other) * self

    def __truediv__(self, other):
        return self._combine(
            other, F.try_divide, lambda a, b, _: F.when(b == 0, "division by zero"))

    def __rtruediv__(self, other):
        return Checked.of(other) / self

    def __pow__(self, other):
        return self._combine(
            other, F.pow,
            lambda a, b, power: F.when((a == 0) & (b < 0), "division by zero").when(
                F.isnan(power) | F.abs(power).isin(float("inf")), "result out of range"))

    def __rpow__(self, other):
        return Checked.of(other) ** self

    def __neg__(self):
        return Checked(-self.value, self.checks)


class Terms:
    """Columns of a table as checked terms; unknown names carry an error."""

    def __init__(self, df: DataFrame):
        self._columns = set(df.columns)

    def __getitem__(self, name: str) -> Checked:
        if name not in self._columns:
            return Checked(F.lit(None), (F.lit(f"unknown column {name}"),))
        column = F.col(name)
        return Checked(column, (F.when(column.isNull(), F.lit(f"no value in {name}")),))


def computed_column(df: DataFrame, formula, places: int = 2,
                    value: str = "value", error: str = "error") -> DataFrame:
    """Add ``value`` and ``error``; ``formula`` maps :class:`Terms` to a Checked."""
    result = Checked.of(formula(Terms(df)))
    return df.withColumns({
        value: F.when(result.error.isNull(), F.bround(result.value, places)),
        error: result.error,
    })
