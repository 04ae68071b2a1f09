"""Table shapes shared by the sources and operators.

Spark rows have no order, so every table carries its position explicitly:
``(shard, row_index)`` for captions and vectors, a global number for images.
"""

from pyspark.sql import types as T

CAPTIONS = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("caption", T.StringType()),
])

VECTORS = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CODES = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("codes", T.ArrayType(T.ShortType())),
])

IMAGE_INDEX = T.StructType([
    T.StructField("part", T.StringType()),
    T.StructField("img_name", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("steps", T.IntegerType()),
    T.StructField("part_id", T.IntegerType()),
    T.StructField("image_number", T.LongType()),
])

QUERY_LIST = T.StructType([
    T.StructField("imgId", T.StringType()),
    T.StructField("prompt", T.StringType()),
])

# One part file: an object keyed by image name; "p" is the prompt, "st" the steps.
PART_METADATA = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("p", T.StringType()),
        T.StructField("st", T.IntegerType()),
    ]),
)

NEIGHBOURS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.FloatType()),
])

KEYWORDS = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("label_id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CENTROIDS = T.StructType([
    T.StructField("shard", T.StringType()),
    T.StructField("centroid_id", T.LongType()),
    T.StructField("center", T.ArrayType(T.DoubleType())),
])
