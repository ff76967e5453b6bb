"""The log tables, derived from the given ``events`` and ``documents`` tables.

Every adapter reads its whole table. ``run_from``/``run_to`` restate a run predicate of the
caller on ``events.ts``, as partition pruning would on a table stored by run; they never
remove a row the caller keeps.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import archive_name, output_name
from ..functions.text import line_bytes
from ..operators.catalog import index_files, index_runs
from ..operators.ordinals import chunk_bounds, line_chunks

FILE = ["run", "ns", "pod", "container"]
ORDER = ["ts", "event_id"]
DOCS_PER_CHUNK = 4_096  # documents are long: some 100 MB of text


# Declared schemas: opening a table needs no job that reads footers.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def with_filename(files: DataFrame) -> DataFrame:
    return files.withColumn("filename", output_name(*[F.col(c) for c in ("ns", "pod", "container", "run")]))


def event_lines(spark: SparkSession, sf_dir: str, run_from: str | None = None,
                run_to: str | None = None) -> DataFrame:
    """One log line per event, with every level word and look-alikes that separate the rules."""
    source = events(spark, sf_dir)
    if run_from:
        source = source.where(F.col("ts") >= ntz(f"{run_from[:10]} 00:00:00"))
    if run_to:
        after = date.fromisoformat(run_to[:10]) + timedelta(days=1)
        source = source.where(F.col("ts") < ntz(f"{after} 00:00:00"))
    lines = source.selectExpr(
        "event_id", "ts", "concat(cast(cast(ts AS date) AS string), '_00-00-00') AS run",
        "concat('ns', user_id % 5) AS ns", "concat('pod-', user_id % 20) AS pod",
        "CASE WHEN user_id % 20 < 10 THEN 'app' ELSE 'sidecar' END AS container",
        """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), ' ',
                  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING'
                       WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'debug'
                       ELSE CASE event_id % 3 WHEN 0 THEN 'errors_total warned'
                                              WHEN 1 THEN 'information' ELSE 'plain' END END,
                  ' user=', user_id, ' ', coalesce(props, '')) AS line""")
    return with_filename(lines.withColumn("n_bytes", line_bytes(F.col("line"))))


def event_bounds(spark: SparkSession, sf_dir: str) -> list[list]:
    """Chunk borders along the event order, from the bare table."""
    return chunk_bounds(events(spark, sf_dir), ORDER)


def log_files(spark: SparkSession, sf_dir: str, run_from: str | None = None,
              run_to: str | None = None, mtime: bool = False) -> DataFrame:
    """File catalog. Grouped by the four name segments; the name is put together afterwards."""
    aggregates = [F.sum(F.col("n_bytes") + 1).cast("bigint").alias("size_bytes"),
                  F.count(F.lit(1)).alias("line_count")]
    if mtime:
        aggregates.append(F.max("ts").alias("mtime"))
    lines = event_lines(spark, sf_dir, run_from, run_to)
    return with_filename(lines.groupBy(*FILE).agg(*aggregates))


def indexed_files(spark: SparkSession, sf_dir: str, sample: int | None, run_from: str | None = None,
                  run_to: str | None = None) -> DataFrame:
    """File catalog with the level counts of the first ``sample`` lines per file."""
    lines = event_lines(spark, sf_dir, run_from, run_to)
    return with_filename(index_files(lines, sample, FILE, ORDER))


def runs(spark: SparkSession, sf_dir: str, run_from: str | None = None,
         run_to: str | None = None) -> DataFrame:
    return index_runs(log_files(spark, sf_dir, run_from, run_to))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of even days are archived; the others stay without an archive on purpose."""
    of = runs(spark, sf_dir)
    return of.where(F.substring("run", 9, 2).cast("int") % 2 == 0).select(
        archive_name(F.col("run")).alias("filename"), "run",
        F.floor(F.col("total_bytes") / 4).cast("bigint").alias("size_bytes"))


def pod_number(pod: str = "pod") -> Column:
    return F.expr(f"cast(substring({pod}, 5) as int)")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved offsets: files read fully, by half, past their end (rotated), not at all; and dead paths."""
    name, size, kind = F.col("filename"), F.col("size_bytes"), pod_number() % 4
    saved = F.when(kind == 0, size).when(kind == 1, F.floor(size / 2)).when(kind == 2, size + 100)
    entries = F.array(
        F.struct(name.alias("path"), saved.cast("bigint").alias("byte_offset")),
        F.struct(F.concat(F.lit("gone/"), name).alias("path"),
                 F.when(F.col("pod") == "pod-7", size).alias("byte_offset")))
    return log_files(spark, sf_dir).select(F.inline(entries)).where(F.col("byte_offset").isNotNull())


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(
        "ns", "pod", F.concat(F.col("container"), F.lit(", init")).alias("containers")).distinct()


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers the node phase covered; some pods are left to the API phase."""
    return (event_lines(spark, sf_dir).select("ns", "pod", "container").distinct()
            .where(pod_number() % 3 != 0)
            .withColumn("rotated", pod_number() % 6 == 1))


ROTATED_BEFORE = "2024-01-06"


def rotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier runs' files stand for the rotated files of each container."""
    files = log_files(spark, sf_dir, run_to="2024-01-05").where(F.col("run") < ROTATED_BEFORE)
    return files.select("ns", "pod", "container",
                        F.concat(F.lit("0.log."), F.substring("run", 1, 10)).alias("name"),
                        "size_bytes", F.col("run").alias("mtime"))


def api_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping fetches of the event lines around a boundary; some lines were logged twice."""
    lines = event_lines(spark, sf_dir)
    lines = lines.unionAll(lines.where(F.col("event_id") % 50 == 0)).select("ns", "pod", "container", "ts", "line")
    first = lines.where(F.col("ts") < ntz("2024-01-15 06:00:00"))
    second = lines.where(F.col("ts") >= ntz("2024-01-14 18:00:00"))
    return (first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2))))


SELECTION_ROWS = 7


def selection(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    """First four files of a run, the first one again, a missing one, and the last file of the day after: seven rows."""
    names = log_files(spark, sf_dir, run, run).select("run", "filename")
    four = names.orderBy("filename").limit(4)
    ranked = four.selectExpr(
        "cast(row_number() over (order by filename) - 1 as int) as sel_idx", "run", "filename")
    again = names.groupBy("run").agg(F.min("filename").alias("filename")).select(
        F.lit(4).alias("sel_idx"), "run", "filename")
    missing = spark.range(1).select(F.lit(5).alias("sel_idx"), F.lit("no-run").alias("run"),
                                    F.lit("no-file.log").alias("filename"))
    after = f"{date.fromisoformat(run[:10]) + timedelta(days=1)}_00-00-00"
    other = log_files(spark, sf_dir, after, after).groupBy("run").agg(F.max("filename").alias("filename")).select(
        F.lit(6).alias("sel_idx"), "run", "filename")
    return ranked.unionByName(again).unionByName(missing).unionByName(other)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: long, multilingual, repeated."""
    docs = documents(spark, sf_dir)
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line",
        F.col("source").alias("ns"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("pod"),
        F.col("lang").alias("container"), line_bytes(F.col("line")).alias("n_bytes"))


def positioned_doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with their byte position in the output of their source.

    One source is one output, so a source with a large share of all text is cut into chunks
    of documents; a document is one row and never larger than a task.
    """
    bounds = chunk_bounds(documents(spark, sf_dir), ["doc_id"], rows_per_chunk=DOCS_PER_CHUNK)
    lines = doc_lines(spark, sf_dir).withColumnRenamed("line_no", "doc_line")
    numbered = line_chunks(lines, ["ns"], ["doc_id", "doc_line"], F.col("n_bytes") + 1,
                           bounds=bounds).numbered()
    return numbered.drop("line_no").withColumnRenamed("doc_line", "line_no")
