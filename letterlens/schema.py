"""Row shapes of the message table."""

from pyspark.sql import types as T

ADDRESSES = T.ArrayType(T.StringType())

# What the header pass yields per message.
HEADERS = T.StructType(
    [
        T.StructField("n_headers", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("from_raw", T.StringType()),
        T.StructField("to_raw", T.StringType()),
        T.StructField("cc_raw", T.StringType()),
        T.StructField("reply_to_raw", T.StringType()),
        T.StructField("subject_raw", T.StringType()),
        T.StructField("date_raw", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("from_addrs", ADDRESSES),
        T.StructField("to_addrs", ADDRESSES),
        T.StructField("cc_addrs", ADDRESSES),
        T.StructField("reply_to_addrs", ADDRESSES),
        T.StructField("from_decoded", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("date_wall", T.TimestampNTZType()),
        T.StructField("date_utc", T.TimestampType()),
        T.StructField("header_error", T.StringType()),
    ]
)

PART = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("main_type", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("charset", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("visible_text", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("size", T.LongType()),
    ]
)

# What the body pass yields per message. The payload field is null unless asked for.
BODY = T.StructType(
    [
        T.StructField("is_multipart", T.BooleanType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("parse_error", T.StringType()),
    ]
)

# What the payload pass yields per message: the parts that were asked for.
LOADED = T.StructType(
    [
        T.StructField(
            "loaded",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("ord", T.IntegerType()),
                        T.StructField("size", T.LongType()),
                        T.StructField("payload", T.BinaryType()),
                    ]
                )
            ),
        ),
        T.StructField("load_error", T.StringType()),
    ]
)

# Attempts of the classifier, recorded so that a run can be replayed.
RESPONSES = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("msg_index", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
