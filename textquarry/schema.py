"""Fixed schemas."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

FILES = StructType([StructField("name", StringType()), StructField("path", StringType()), StructField("size", LongType()), StructField("mtime", TimestampType()), StructField("is_dir", BooleanType())])
DOCS = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("file_type", StringType()), StructField("text", StringType()), StructField("extract_error", StringType())])
RESULT = StructType([StructField("path", StringType()), StructField("line_number", LongType()), StructField("line_content", StringType()), StructField("context_before", ArrayType(StringType())), StructField("context_after", ArrayType(StringType())), StructField("bm25_score", DoubleType())])
CACHE = StructType([StructField("sha256", StringType()), StructField("text", StringType()), StructField("size", LongType()), StructField("last_used", TimestampType())])
