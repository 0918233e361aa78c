"""The one record type: every source gives it, every sink takes it."""

from pyspark.sql import types as T

#: Bytes of sequences and qualities are characters of ISO-8859-1: one character is one byte.
SEQUENCES = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("sample", T.StringType()),
        T.StructField("ordinal", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("seq", T.StringType(), False),
        T.StructField("qual", T.StringType()),
    ]
)
COLUMNS = SEQUENCES.fieldNames()
