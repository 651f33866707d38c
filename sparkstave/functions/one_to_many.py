"""A table function for SQL: one value in, a row for each of its pieces out.

``SELECT d.id, x.place, x.item FROM docs d, LATERAL one_to_many(d.text, ',') x`` cuts texts, ``one_to_many(d.list)`` lists of any type: the
type of ``item`` is that of the argument's elements. Nulls and empty lists have no rows, empty texts one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class OneToMany:
    @staticmethod
    def analyze(value: AnalyzeArgument, separator: AnalyzeArgument | None = None) -> AnalyzeResult:
        if isinstance(value.dataType, ArrayType):
            item = value.dataType.elementType
        elif isinstance(value.dataType, StringType) and separator is not None:
            item = StringType()
        else:
            raise ValueError("one_to_many takes a list, or a text and a separator")
        return AnalyzeResult(StructType().add("place", IntegerType()).add("item", item))

    def eval(self, value, separator=None) -> Iterator[tuple]:
        if value is not None:
            yield from enumerate(value.split(separator) if isinstance(value, str) else value)


def register(spark: SparkSession) -> None:
    spark.udtf.register("one_to_many", udtf(OneToMany))
