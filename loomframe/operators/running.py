"""Running sums and maxima over a whole table, in as many tasks as it has partitions.

Rows are dealt out by range in the wanted order and written once.  A window
function then needs to see one partition only; what lies before it is added from
the partitions' totals, which are one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import durable

PART = "_part"


class Ordered:
    """A table in the order of a numeric column whose values are distinct, from the largest down."""

    def __init__(self, rows: DataFrame, by: str):
        self.by = F.desc(by)
        self.rows = durable(rows.repartitionByRange(self.by).withColumn(PART, F.spark_partition_id()), "ordered")
        # a partition's place follows from its largest value
        self.window = Window.partitionBy(PART).orderBy(self.by)
        self.upto = self.window.rowsBetween(Window.unboundedPreceding, 0)

    def _before(self, rows: DataFrame, facts: dict[str, Column], join, start: dict, backwards: bool = False) -> DataFrame:
        """(part, facts of all partitions before it, or after it), a row for each partition."""
        parts = sorted((r.asDict() for r in rows.groupBy(PART).agg(*(c.alias(n) for n, c in facts.items())).collect()), key=lambda r: r[PART], reverse=backwards)
        out, held = [], dict(start)
        for r in parts:
            out.append((r[PART], *held.values()))
            held = {n: join(held[n], r[n]) for n in held}
        kinds = {n: "double" if isinstance(v, float) else "long" for n, v in start.items()}
        schema = f"{PART} int" + "".join(f", {n} {k}" for n, k in kinds.items())
        return rows.sparkSession.createDataFrame(out, schema)

    def sums(self, columns: dict[str, str], index: str | None = None) -> Ordered:
        """Adds each running sum (whole numbers) and the place of each row from 0."""
        facts = {f"_{n}": F.coalesce(F.sum(c), F.lit(0)) for n, c in columns.items()} | {"_rows": F.count(F.lit(1))}
        before = self._before(self.rows, facts, lambda a, b: a + b, dict.fromkeys(facts, 0))
        rows = self.rows.join(F.broadcast(before), PART)  # a row for each partition
        named = {n: (F.sum(c).over(self.upto) + F.col(f"_{n}")).cast("long") for n, c in columns.items()}
        if index:
            named[index] = (F.row_number().over(self.window) - 1 + F.col("_rows")).cast("long")
        self.rows = rows.withColumns(named).drop(*facts)
        return self

    def greatest(self, column: str, name: str) -> Ordered:
        """Adds the running maximum of a column of whole numbers, none below 0."""
        before = self._before(self.rows, {"_most": F.max(column)}, max, {"_most": 0})
        self.rows = self.rows.join(F.broadcast(before), PART).withColumn(name, F.greatest(F.max(column).over(self.upto), "_most")).drop("_most")
        return self

    def following(self, column: str, name: str) -> Ordered:
        """Adds the next row's value of a column that never falls; null in the last row."""
        after = self._before(self.rows, {"_next": F.min(column)}, lambda _, b: b, {"_next": -1}, backwards=True)
        nxt = F.coalesce(F.lead(column).over(self.window), F.when(F.col("_next") >= 0, F.col("_next")))
        self.rows = self.rows.join(F.broadcast(after), PART).withColumn(name, nxt).drop("_next")
        return self
