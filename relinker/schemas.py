"""Schemas of the tables that are read from or written to storage."""
from pyspark.sql import types as T

HOP = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("location", T.StringType()),
])

CHECKS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("hops", T.ArrayType(HOP)),
])

VOTES = T.StructType([
    T.StructField("url_404", T.StringType(), False),
    T.StructField("algo", T.StringType(), False),
    T.StructField("match_url", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("match_idx", T.LongType()),
])

HISTORY = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("url_404", T.StringType()),
    T.StructField("redirect_url", T.StringType()),
    T.StructField("agreement_score", T.LongType()),
    T.StructField("total_score", T.DoubleType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("is_best_match", T.BooleanType()),
    T.StructField("source", T.StringType()),
])

VERDICTS = T.StructType([
    T.StructField("url_404", T.StringType()),
    T.StructField("choice", T.StringType()),
    T.StructField("manual_url", T.StringType()),
])

TOPICS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("topic", T.IntegerType()),
    T.StructField("prob", T.DoubleType()),
])
