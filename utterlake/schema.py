"""Schemas of the utterance domain."""

from pyspark.sql import types as T

UTTERANCE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("org_media_path", T.StringType()),
        T.StructField("org_transcription_path", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("speaker", T.StringType()),
    ]
)
PAIR = "array<struct<ref:string,hyp:string>>"
CLUSTER = "array<struct<ref:array<string>,hyp:array<string>>>"
TRAIN_LOG = "run string, epoch int, training_ler double, valid_ler double, last_batch_ler double"
