"""A polymorphic table function: how far each key's rows go through a sequence of steps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@F.udtf
class Funnel:
    """funnel(TABLE(t), 'key', 'step', array('first', 'second', ...)): of each key how many steps are met in this order, and its rows.

    The table must have event_id, which orders a key's rows. The result's key column has the name and type that it has in the
    table. State is a counter a key; a null step meets nothing; rows of a null key are one group; no rows give no rows.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, step: AnalyzeArgument, steps: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table")
        columns = {f.name: f.dataType for f in table.dataType.fields}
        for name in (key.value, step.value, "event_id"):
            if name not in columns:
                raise ValueError(f"the table has no column {name}")
        schema = T.StructType([T.StructField(key.value, columns[key.value]), T.StructField("reached", T.IntegerType()), T.StructField("n_rows", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("event_id")])

    def __init__(self) -> None:
        self.reached, self.rows, self.key = 0, 0, None

    def eval(self, row: T.Row, key: str, step: str, steps: list[str]) -> None:
        self.rows, self.key = self.rows + 1, row[key]
        if self.reached < len(steps) and row[step] == steps[self.reached]:
            self.reached += 1

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield self.key, self.reached, self.rows
