"""Schemas shared by sources and operators."""

from pyspark.sql import types as T

PARSED_MESSAGE = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("service_id", T.LongType()),
    T.StructField("method_id", T.LongType()),
    T.StructField("payload", T.StringType()),
])

# On disk, catalogue records name their ids with a blank.
CATALOGUE_RECORD = T.StructType([
    T.StructField("messagename", T.StringType()),
    T.StructField("isCAN", T.BooleanType()),
    T.StructField("service id", T.LongType()),
    T.StructField("method id", T.LongType()),
    T.StructField("direction", T.StringType()),
])

NONCAN_RECORD = T.StructType([
    T.StructField("messageName", T.StringType()),
    T.StructField("signals", T.ArrayType(T.StringType())),
])

SIGNAL_DEFINITION = T.StructType([
    T.StructField("msgid", T.StringType()),
    T.StructField("start_byte", T.IntegerType()),
    T.StructField("start_bit", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("choices", T.MapType(T.StringType(), T.StringType())),
    T.StructField("minimum", T.DoubleType()),
    T.StructField("maximum", T.DoubleType()),
    T.StructField("offset", T.DoubleType()),
    T.StructField("factor", T.DoubleType()),
])

# direction -> namespace -> message -> signal -> definition
SIGNAL_DICTIONARY = T.MapType(
    T.StringType(),
    T.MapType(
        T.StringType(),
        T.MapType(T.StringType(), T.MapType(T.StringType(), SIGNAL_DEFINITION)),
    ),
)

TRAINING_SAMPLE = T.StructType([T.StructField("text", T.StringType())])

DEFINITION_FIELDS = tuple(f.name for f in SIGNAL_DEFINITION.fields)
