"""The canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: One data point. A null value is a real gap. ``obs_seq`` is the order of arrival, which decides
#: wherever "the first" counts; Spark keeps no order of rows by itself.
OBSERVATIONS = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("geography", T.StringType()),
        T.StructField("iso3", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("obs_seq", T.LongType()),
    ]
)

#: Which column of a dataset a series becomes; ``ordinal`` is the column's place.
VARIABLES = T.StructType(
    [
        T.StructField("alias", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("concept", T.StringType()),
        T.StructField("coverage_end", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
    ]
)

#: One finding of validation.
ISSUES = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)
