"""Tables along a space-filling curve, and range boxes over several attributes at once.

Each attribute is cut into 2^bits equal cells between its least and greatest value, and the bits of the cells' numbers
are dealt into one number in turn (the Z-order curve), so that rows near each other in all attributes lie near each other
in the table. A table is written in the order of that number. A box is cut into intervals of the curve, by halving the
space until a piece lies inside the box or the intervals are as many as allowed; Parquet's statistics of the number then
rule out files and row groups, and the exact comparison decides about each row.

Validity intervals are points of (valid_from, valid_to): a time is the box of all that began by then and end later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intervals that a box is cut into at most.
INTERVALS = 64


@dataclass(frozen=True)
class Curve:
    """Attributes with their least and greatest values."""

    columns: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    bits: int

    def cell_of(self, i: int, value: float) -> int:
        span = self.high[i] - self.low[i]
        return min(max(int((value - self.low[i]) / span * (1 << self.bits)), 0), (1 << self.bits) - 1) if span > 0 else 0

    def cell(self, i: int) -> Column:
        span = self.high[i] - self.low[i]
        top = (1 << self.bits) - 1
        if span <= 0:
            return F.lit(0).cast("long")
        at = F.floor((F.col(self.columns[i]).cast("double") - self.low[i]) / span * (1 << self.bits))
        return F.least(F.greatest(at, F.lit(0)), F.lit(top)).cast("long")

    def place(self) -> Column:
        """The number of a row on the curve; a null attribute counts as its least value."""
        k = len(self.columns)
        out = F.lit(0).cast("long")
        for i in range(k):
            c = F.coalesce(self.cell(i), F.lit(0).cast("long"))
            for b in range(self.bits):
                out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * k + i))
        return out

    def intervals(self, low: list[float | None], high: list[float | None], most: int = INTERVALS) -> list[tuple[int, int]]:
        """Ascending stretches of the curve that hold all cells of a box; None leaves a side open."""
        k = len(self.columns)
        a = [0 if v is None else self.cell_of(i, v) for i, v in enumerate(low)]
        b = [(1 << self.bits) - 1 if v is None else self.cell_of(i, v) for i, v in enumerate(high)]
        if any(x > y for x, y in zip(a, b)):
            return []
        # (first number, corner, size in bits) of cubes; each round halves those that the box cuts
        inside: list[tuple[int, int]] = []
        cut = [(0, (0,) * k, self.bits)]
        while cut:
            nxt = []
            for z, corner, size in cut:
                if all(x <= c and c + (1 << size) - 1 <= y for x, y, c in zip(a, b, corner)):
                    inside.append((z, z + (1 << size * k) - 1))
                    continue
                for child in range(1 << k):
                    c = tuple(v + ((child >> i & 1) << (size - 1)) for i, v in enumerate(corner))
                    if all(c[i] <= b[i] and c[i] + (1 << (size - 1)) - 1 >= a[i] for i in range(k)):
                        nxt.append((z + (child << (size - 1) * k), c, size - 1))
            cut = nxt
            if len(cut) + len(inside) > most:
                inside += [(z, z + (1 << size * k) - 1) for z, _, size in cut]
                break
        out: list[list[int]] = []
        for x, y in sorted(inside):
            if out and x == out[-1][1] + 1:
                out[-1][1] = y
            else:
                out.append([x, y])
        return [(x, y) for x, y in out]


def write(df: DataFrame, columns: list[str], path: str, files: int, bits: int = 12, name: str = "_place") -> Curve:
    """Write ``df`` to ``path`` in the order of the curve over ``columns``, which are numbers, and give the curve."""
    if bits * len(columns) > 62:
        raise ValueError("a place on the curve has 62 bits at most")
    ends = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    low, high = (tuple(float(v or 0.0) for v in ends[s::2]) for s in (0, 1))
    curve = Curve(tuple(columns), low, high, bits)
    df.withColumn(name, curve.place()).repartitionByRange(files, name).sortWithinPartitions(name).write.parquet(path)
    return curve


def box(spark: SparkSession, path: str, curve: Curve, low: list[float | None], high: list[float | None], most: int = INTERVALS, name: str = "_place") -> DataFrame:
    """Rows of a table on a curve with every attribute between ``low`` and ``high``, both included; None leaves a side open.

    Rows with a null attribute that the box bounds don't match.
    """
    t = spark.read.parquet(path)
    parts = curve.intervals(low, high, most)
    if not parts:
        return t.limit(0).drop(name)
    near = F.lit(False)
    for a, b in parts:
        near = near | F.col(name).between(a, b)
    exact = F.lit(True)
    for c, a, b in zip(curve.columns, low, high):
        exact = exact & (F.lit(True) if a is None else F.col(c) >= a) & (F.lit(True) if b is None else F.col(c) <= b)
    return t.filter(near & exact).drop(name)
