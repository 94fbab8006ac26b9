from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def docs(spark, rows):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows], DOCS)


def crc(doc_id) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode())
