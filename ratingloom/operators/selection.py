"""The first n rows in an order of whole numbers, found by histograms: no sort and no shuffle of rows.

The row in place n has a *threshold* in each column of the order. It is found column by column: a
histogram over the rows that are still possible tells the bin that holds the place, the next one
refines that bin alone, until it is one number; rows that agree with all thresholds so far go on to the
next column. A pass reads narrow columns and returns at most ``BINS`` counts; its range is a plain
filter, which reaches the scan. Both parts of the table are then filters too. Only rows that are equal
in every column can share the last place, and of these it does not matter which are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram; they reach the driver.
BINS = 4096


@dataclass
class Cut:
    """Where the first part ends: thresholds (None: null), and of the ``equal`` rows there, how many.

    ``nulls`` tells whether a column has nulls, among the rows that agree with the thresholds before it.
    """

    order: list[Column]
    values: list[int | None]
    nulls: list[bool]
    take: int
    equal: int

    def at(self) -> Column:
        """Rows that are equal to the threshold in all columns."""
        out = F.lit(True)
        for column, value in zip(self.order, self.values):
            out = out & column.eqNullSafe(F.lit(value))
        return out

    def before(self) -> Column:
        """Rows in front of the threshold; nulls come first."""
        out = F.lit(False)
        for column, value, nulls in list(zip(self.order, self.values, self.nulls))[::-1]:
            less = F.lit(False) if value is None else column < value
            less = column.isNull() | less if nulls and value is not None else less
            out = less | (column.eqNullSafe(F.lit(value)) & out)
        return out & self.reach(True)

    def reach(self, first: bool) -> Column:
        """What the first column alone says of the first part or the rest: a range that scans can use."""
        column, value = self.order[0], self.values[0]
        if value is None:
            return column.isNull() if first else F.lit(True)
        if first:
            return column.isNull() | (column <= value) if self.nulls[0] else column <= value
        return column >= value


def full_order(df: DataFrame, order: list[Column | str]) -> list[Column]:
    """The order as longs, extended so that only equal rows are equal in it.

    Columns that the order does not name come last, as two hashes of the whole row.
    """
    named = {c for c in order if isinstance(c, str)}
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    columns = [c.cast("bigint") for c in columns]
    if named >= set(df.columns):
        return columns
    return [*columns, F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)]


def find_cut(df: DataFrame, order: list[Column | str], n: int, bins: int = BINS) -> Cut | None:
    """The cut behind the first ``n`` rows, ``n >= 1``; None if there are no more than ``n``.

    ``df`` is read once for each histogram: give a table that has been written.
    """
    columns = full_order(df, order)
    here, left, values, has_nulls, equal = F.lit(True), n, [], [], 0
    for i, column in enumerate(columns):
        one = F.count(F.lit(1))
        seen = df.where(here).agg(
            one.alias("rows"), F.count(column).alias("known"), F.min(column).alias("low"), F.max(column).alias("high")
        ).first()
        if i == 0 and n >= seen["rows"]:
            return None
        nulls, low, high, value = seen["rows"] - seen["known"], seen["low"], seen["high"], None
        equal = nulls
        if left > nulls:
            left, equal = left - nulls, seen["known"]
            while low < high:
                width = (high - low) // bins + 1
                # Rounded towards zero, the bin around zero is twice as wide; no sum can overflow.
                which = F.call_function("div", column, F.lit(width))
                counts = df.where(here & column.between(low, high)).groupBy(which.alias("bin")).agg(
                    one.alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
                )
                for r in sorted(counts.collect(), key=lambda r: r["low"]):
                    if left <= r["n"]:
                        low, high, equal = r["low"], r["high"], r["n"]
                        break
                    left -= r["n"]
            value = low
        values.append(value)
        has_nulls.append(nulls > 0)
        here = here & column.eqNullSafe(F.lit(value))
    return Cut(columns, values, has_nulls, left, equal)


def _copies(rows: DataFrame, n: int) -> DataFrame:
    """``n`` copies of the one row that ``rows`` repeats."""
    times = F.explode(F.sequence(F.lit(1), F.lit(n)))
    return rows.distinct().select(F.struct(*rows.columns).alias("row"), times).select("row.*")


def split_at(df: DataFrame, order: list[Column | str], n: int, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows and the others, each a filter of ``df``."""
    if n <= 0:
        return df.where(F.lit(False)), df
    cut = find_cut(df, order, n, bins)
    if cut is None:
        return df, df.where(F.lit(False))
    before, at = cut.before(), cut.at()
    if cut.take == cut.equal:
        return df.where(cut.reach(True) & (before | at)), df.where(cut.reach(False) & ~before & ~at)
    first = df.where(before).union(_copies(df.where(at), cut.take))
    return first, df.where(cut.reach(False) & ~before & ~at).union(_copies(df.where(at), cut.equal - cut.take))
