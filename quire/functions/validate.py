"""C14: validate rows against a declared schema's required fields.

Required (non-nullable) fields must be present and not null; array fields
must not hold null elements. Rows are split, not failed: ``validation_errors``
lists the failing fields, so good rows go on and bad rows are quarantined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def validation_errors(schema: T.StructType, present: list[str]):
    checks = []
    for f in schema.fields:
        if f.nullable:
            continue
        if f.name not in present:
            checks.append(F.lit(f.name))
            continue
        c = F.col(f.name)
        bad = c.isNull()
        if isinstance(f.dataType, T.ArrayType):
            bad = bad | F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
        checks.append(F.when(bad, F.lit(f.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array()


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumn("validation_errors", validation_errors(schema, df.columns))


def split_valid(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    v = validate(df, schema)
    ok = F.size("validation_errors") == 0
    return v.filter(ok).drop("validation_errors"), v.filter(~ok)
