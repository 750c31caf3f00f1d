"""File sources and sinks: structured files, folders of them, iCalendar files, atomic and per-key output, through Spark's file systems."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kalends.operators.ical import BORDER, components, content_lines, text_events


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def optional_scan(spark: SparkSession, path: str, schema: str | StructType, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What `read` gives, or an empty table where the path doesn't exist; other errors stay errors."""
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, name, content) of the files of a folder whose names fit a pattern, as text; none where there is no such folder."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, name string, content string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("content"))


def parsed(files: DataFrame, schema: str) -> DataFrame:
    """(file, name, value, error) of texts (file, name, content): JSON by name, else YAML; `value` by `schema`, or why it can't be read, with the path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, name, content in zip(b["file"], b["name"], b["content"], strict=True):
                try:
                    value = json.loads(content) if name.endswith(".json") else yaml.safe_load(content)
                    out.append((file, name, json.dumps(value, default=str), None))
                except (ValueError, yaml.YAMLError) as e:
                    out.append((file, name, None, f"{file}: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["file", "name", "raw", "error"])

    rows = files.mapInPandas(parse, "file string, name string, raw string, error string")
    return rows.select("file", "name", F.from_json("raw", schema).alias("value"), "error")


def structured_files(spark: SparkSession, path: str, schema: str, pattern: str = "*.{json,yaml,yml}") -> DataFrame:
    """The parsed JSON and YAML files of a folder, in order of their names."""
    return parsed(raw_files(spark, path, pattern), schema).orderBy("name")


def validated(files: DataFrame, faults: Column) -> DataFrame:
    """Files' values; the first file with an error or fault (an array column of names) fails the job, with its path."""
    why = F.coalesce(F.col("error"), F.when(F.size(faults) > 0, F.concat_ws(": ", "file", F.array_join(faults, ", "))))
    return files.withColumn("value", F.when(F.coalesce(F.assert_true(why.isNull(), why).isNull(), F.lit(True)), F.col("value")))


def ics_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, properties) of the entries of a folder's iCalendar files."""
    texts = raw_files(spark, path, "*.ics").select("file", "content")
    return components(content_lines(texts, "content", "file"), "file")


def write_atomically(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a table beside its place and then moves it there, so that readers see the old one or the new one."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(kind).save(staged)
    (target, files), (source, _) = _place(spark, path), _place(spark, staged)
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{staged} can't be moved to {path}")


def write_if_valid(df: DataFrame, path: str, faults: Callable[[DataFrame], DataFrame], kind: str = "json") -> bool:
    """Writes a candidate table only if it has no faults; otherwise what is there stays."""
    if not faults(df).isEmpty():
        return False
    write_atomically(df, path, kind)
    return True


def write_read_model(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON table for each name of a read model."""
    for name, df in tables.items():
        write_atomically(df, f"{folder.rstrip('/')}/{name}")


def write_calendars(df: DataFrame, folder: str, key: str = "file", text: str = "calendar") -> None:
    """Calendars by key: a folder for each, whose text is the file's."""
    df.select(F.col(key), F.regexp_replace(text, "\r\n$", "").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").partitionBy(key).text(folder)


def write_calendar_rows(rows: DataFrame, folder: str, key: str) -> None:
    """The same folders from `calendar_rows`: each calendar is written row by row by one task, so that none is held as a value."""
    # a column that may be null or empty would be replaced by the writer, which then sorts by it alone
    named = rows.withColumn(key, F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))
    ordered = named.repartition(key).sortWithinPartitions(key, "place", "start_key", "occurrence").select(key, F.col("entry").alias("value"))
    ordered.write.mode("overwrite").option("lineSep", "\r\n").partitionBy(key).text(folder)


def calendar_events(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file, entry, lines) of the VEVENTs of the iCalendar files below a folder, as `text_events` gives them of texts.

    Files are read by lines, also by several tasks, and only an event is gathered; a line's place is its block's and its own in the order in
    which the block is read. Events whose BEGIN line is folded itself have the number of the one before.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    w = W.partitionBy("file").orderBy("_block", "_id").rowsBetween(W.unboundedPreceding, 0)
    begins, ends = (F.concat(F.lit("\n"), F.col("value")).rlike(BORDER % name) for name in ("BEGIN", "END"))
    placed = raw.withColumns({"_entry": F.sum(F.when(begins, 1).otherwise(0)).over(w), "_open": F.last(F.when(begins, True).when(ends, False), ignorenulls=True).over(w)})
    # what stands between events is of none
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_id", "value"))), lambda x: x["value"]), "\n")
    one = placed.where("_open").groupBy("file", "_entry").agg(text.alias("_text"))
    return text_events(one, "_text", "file", "_entry").select("file", F.col("_entry").alias("entry"), "lines")


def catalog_document(events: DataFrame, occurrences: DataFrame, generated: str) -> DataFrame:
    """(part, document): a JSON document of each part of the catalog, dealt by a hash of the event so that none holds all."""
    part = lambda: F.pmod(F.xxhash64("event"), F.lit(16)).alias("part")
    e = events.select(part(), F.struct(*[c for c in sorted(events.columns)]).alias("r")).groupBy("part").agg(F.array_sort(F.collect_list(F.to_json("r"))).alias("e"))
    o = occurrences.select(part(), F.struct(*[c for c in sorted(occurrences.columns)]).alias("r")).groupBy("part").agg(F.array_sort(F.collect_list(F.to_json("r"))).alias("o"))
    lists = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    both = e.join(o, "part", "full_outer")
    return both.select("part", F.concat(F.lit(f'{{"version":1,"generatedAt":"{generated}","events":'), lists("e"), F.lit(',"occurrences":'), lists("o"), F.lit("}")).alias("document"))


def findings(faults: DataFrame, key: str, most: int = 20) -> tuple[str, int]:
    """A report's text and exit code: how many findings, the first few of them, and 1 if there are any."""
    n = faults.count()
    rows = faults.orderBy(key).limit(most).collect()
    lines = [f"{n} findings", *(" ".join(str(v) for v in r) for r in rows)]
    return "\n".join(lines + ([f"and {n - most} more"] if n > most else [])), int(n > 0)


def report(faults: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(place, line) of the same report as a table: the count at place 0, the first findings by key, and how many more there are."""
    n = faults.agg(F.count("*").alias("n"))
    first = faults.orderBy(key).limit(most).select(F.array(F.struct(F.col(key).alias("_k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in faults.columns]).alias("line"))).alias("r"))
    lines = first.agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r")).select(F.posexplode("r").alias("place", "r")).select((F.col("place") + 1).alias("place"), "r.line")
    head = n.select(F.lit(0).alias("place"), F.concat(F.col("n").cast("string"), F.lit(" findings")).alias("line"))
    more = n.where(F.col("n") > most).select(F.lit(most + 1).alias("place"), F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"))
    return head.unionByName(lines).unionByName(more)
