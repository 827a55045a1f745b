"""Windows over series: one place for partitioning, order, frames and warm-up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """How a frame holds many series: partition keys, and an order that is unique in each."""

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, size: int):
        check_window(size)
        return self.window.rowsBetween(1 - size, 0)

    @property
    def so_far(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def number(self) -> Column:
        return F.row_number().over(self.window)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.window)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.window)

    def rolling(self, aggregate: Column, size: int, first: int | None = None) -> Column:
        """A trailing aggregate; null until ``first`` rows (``size`` if not given) are there."""
        return F.when(self.number >= (size if first is None else first), aggregate.over(self.rows(size)))

    def carried(self, c: Column) -> Column:
        """The last value that is not null."""
        return F.last(c, ignorenulls=True).over(self.so_far)

    def running(self, aggregate: Column) -> Column:
        return aggregate.over(self.so_far)

    def kernel(self, df: DataFrame, inputs: Sequence[str], outputs: dict[str, str], f: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
        """Adds columns of a sequential kernel: f gets each input of a series as an array of
        doubles in order and returns the outputs (name: type given in ``outputs``); NaN becomes null.

        One series is one task's work: recursion leaves no other way.
        """
        keep = [c for c in df.columns if c not in outputs]
        order = list(self.order)

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(order, kind="stable").reset_index(drop=True)
            made = f(*(part[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs))
            for name, kind in outputs.items():
                values = np.asarray(made[name])
                if kind == "double":
                    part[name] = values
                else:
                    missing = np.isnan(values.astype(float))
                    part[name] = pd.array(np.where(missing, 0, values).astype("int64"), dtype="Int64")
                    part.loc[missing, name] = pd.NA
            return part[[*keep, *outputs]]

        fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        out = df.groupBy(*self.keys).applyInPandas(run, f"{fields}, " + ", ".join(f"`{n}` {k}" for n, k in outputs.items()))
        return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, k in outputs.items() if k == "double"})


def check_window(size: int, least: int = 1) -> None:
    if size < least:
        raise ValueError(f"window must be at least {least}, not {size}")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def exact_sum(x: Column, digits: int = 6) -> Column:
    """A sum of doubles that stand for decimals of up to so many places, the same in any order; the plain sum where a value is not one or is too large."""
    units = F.round(x * 10.0**digits)
    whole = F.try_sum(F.when(F.abs(units) < 2.0**53, units).try_cast("bigint"))
    fits = F.bool_and((F.abs(units) < 2.0**53) & (F.abs(x * 10.0**digits - units) < 1e-3))
    return F.when(fits & whole.isNotNull(), whole / 10.0**digits).otherwise(F.sum(x))


def sorted_sum(x: Column) -> Column:
    """A sum of a few doubles in the order of their size, the same in any order of rows."""
    return F.when(F.count(x) > 0, F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda a, b: a + b))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as doubles divide: infinite where only b is zero, not a number where both are."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a.isNotNull() & b.isNotNull(), F.signum(a) * F.lit(float("inf")))


def ieee_ln(a: Column) -> Column:
    """The logarithm of doubles: minus infinity at zero, not a number below."""
    return F.when(a > 0, F.ln(a)).when(a == 0, float("-inf")).when(a.isNotNull(), float("nan"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, for comparison between engines; minus zero becomes zero."""
    return df.select(*(((F.round(F.col(c) * 10**digits) / 10**digits + F.lit(0.0)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))
