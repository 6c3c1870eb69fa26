"""The long event table."""

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("socket", T.IntegerType()), T.StructField("device", T.StringType()),
    T.StructField("core", T.IntegerType()), T.StructField("thread", T.IntegerType()), T.StructField("unit", T.IntegerType()), T.StructField("module", T.IntegerType()),
    T.StructField("tsc", T.DoubleType()), T.StructField("group", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()),
])

SAMPLING_TIME = "$samplingTime"
PROCESSED_SAMPLES = "$processed_samples"
TSC = "TSC"
#: Events that aren't rates.
UNSCALED = [SAMPLING_TIME, PROCESSED_SAMPLES]
