"""The canonical columns of the library. Ratings may also have ``seq``, a row's arrival order."""

from pyspark.sql import types as T

#: Ratings as they are read from triples, without an arrival order.
TRIPLE = T.StructType(
    [
        T.StructField("item", T.IntegerType()),
        T.StructField("user", T.IntegerType()),
        T.StructField("rating", T.IntegerType()),
    ]
)
