"""Table schemas and fixed values shared by every module."""

from pyspark.sql import types as T

LOG_LINES = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("ns", T.StringType()),
    T.StructField("pod", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("start_byte", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("line", T.StringType()),
    T.StructField("ts_key", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

LOG_FILES = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("ns", T.StringType()),
    T.StructField("pod", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("line_count", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("warn_count", T.LongType()),
    T.StructField("info_count", T.LongType()),
    T.StructField("debug_count", T.LongType()),
])

RUNS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("run_ts", T.TimestampType()),
    T.StructField("file_count", T.LongType()),
    T.StructField("total_bytes", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

ARCHIVES = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

OFFSETS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("byte_offset", T.LongType()),
])

SELECTION = T.StructType([
    T.StructField("sel_idx", T.IntegerType()),
    T.StructField("run", T.StringType()),
    T.StructField("filename", T.StringType()),
])

CONTAINER = ["ns", "pod", "container"]

# Fixed values.
RUN_FORMAT = "yyyy-MM-dd_HH-mm-ss"
SOURCE_GROUPS = 10            # sources of a merged view are marked in so many groups
PART_BYTES = 100 * 1024 * 1024
MTIME_TOLERANCE_S = 300
API_OVERLAP_S = 60
RETENTION_MONTH_DAYS = 30
