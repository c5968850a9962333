"""Explicit schemas for every input the library reads (no inference pass)."""

from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_len", T.IntegerType()),
    T.StructField("doc_num", T.LongType()),
])

FAQ_RECORD = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
])
FAQ_MAP = T.MapType(T.StringType(), T.ArrayType(FAQ_RECORD))

QUESTION = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("source", T.ArrayType(T.LongType())),
    T.StructField("query", T.StringType()),
    T.StructField("category", T.StringType()),
])
QUESTIONS_FILE = T.StructType([T.StructField("questions", T.ArrayType(QUESTION))])

TRUTH = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("retrieve", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("generate", T.StringType()),
])
TRUTHS_FILE = T.StructType([T.StructField("ground_truths", T.ArrayType(TRUTH))])

PREDICTION = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("retrieve", T.StringType()),
    T.StructField("incre_num_by", T.IntegerType()),
])

ANSWER = T.StructType([
    T.StructField("qid", T.IntegerType()),
    T.StructField("retrieve", T.IntegerType()),
])
ANSWERS_FILE = T.StructType([T.StructField("answers", T.ArrayType(ANSWER))])

FEATURE_ROW = T.StructType([
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
    T.StructField("start_positions", T.IntegerType()),
    T.StructField("end_positions", T.IntegerType()),
    T.StructField("overflow_to_sample_mapping", T.IntegerType()),
])

LOGITS = T.StructType([
    T.StructField("start_logits", T.ArrayType(T.FloatType())),
    T.StructField("end_logits", T.ArrayType(T.FloatType())),
])

TRIAL = T.StructType([
    T.StructField("study", T.StringType()),
    T.StructField("trial_id", T.LongType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("state", T.StringType()),
])

# Document tree flattened to one row per node.
DOC_NODE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("page_no", T.IntegerType()),
])
