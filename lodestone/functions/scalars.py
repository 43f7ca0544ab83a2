"""Scalar helpers whose results don't depend on the order of additions or on an engine's casts."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cents(x: str) -> Column:
    """Money as whole cents, so that sums are exact."""
    return F.round(F.col(x) * 100).cast("long")


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Discounted price in units of 1/10000."""
    return cents(price) * (100 - F.round(F.col(discount) * 100).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def json_int(column: str, path: str) -> Column:
    return F.get_json_object(column, path).cast("long")


@F.pandas_udf(T.LongType())
def digit_sum(x: pd.Series) -> pd.Series:
    """Sum of a number's decimal digits: an Arrow-batched user function."""
    return x.abs().astype(str).map(lambda s: sum(map(int, s)))


@F.arrow_udf(T.StringType())
def backwards(x: pa.Array) -> pa.Array:
    """A text's code points in reverse: a user function on Arrow arrays, without pandas."""
    return pc.utf8_reverse(x)


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class WordsOf:
    """A text's words with their places, as a table function."""

    def eval(self, text: str):
        for i, word in enumerate((text or "").split()):
            yield word, i
