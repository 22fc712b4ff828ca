"""Files of several generations read as one schema.

Files written before a column existed, or with a narrower type, are brought to the
present schema folder by folder: a missing column is null, a narrower number is
widened, a column the schema does not know is left out. A type that cannot be widened
without loss is an error that names folder and column, not a null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# From narrow to wide; a float holds no wider integer than a short without loss.
INTEGERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
WIDER: dict[T.DataType, tuple[T.DataType, ...]] = {
    T.ByteType(): (*INTEGERS[1:], T.FloatType(), T.DoubleType()),
    T.ShortType(): (*INTEGERS[2:], T.FloatType(), T.DoubleType()),
    T.IntegerType(): (T.LongType(), T.DoubleType()),
    T.FloatType(): (T.DoubleType(),),
    T.DateType(): (T.TimestampType(),),
}


def widens(have: T.DataType, wanted: T.DataType) -> bool:
    """Whether every value of one type is a value of the other."""
    if isinstance(have, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return widens(have.elementType, wanted.elementType)
    return have == wanted or isinstance(have, T.NullType) or wanted in WIDER.get(have, ())


def conform(rows: DataFrame, schema: T.StructType, where: str, keep: Iterable[str] = ()) -> DataFrame:
    """The rows with exactly the columns of the schema, and those of ``keep`` as they are."""
    present = {f.name: f.dataType for f in rows.schema}

    def column(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        have = present[field.name]
        if not widens(have, field.dataType):
            kinds = f"{have.simpleString()}, not {field.dataType.simpleString()}"
            raise TypeError(f"{where}: column {field.name} is {kinds}")
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return rows.select(*map(column, schema.fields), *keep)


def read_generations(spark: SparkSession, folders: Iterable[str], schema: T.StructType) -> DataFrame:
    """Parquet folders, each of one generation, as one frame."""
    each = [conform(spark.read.option("mergeSchema", True).parquet(f), schema, f) for f in folders]
    return reduce(DataFrame.unionByName, each)
