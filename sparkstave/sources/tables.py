"""Readers and writers: catalogs, listings, whole files, manifests, splits, artefacts, statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkstave.sources.scores import file_system

#: Files of one folder that is written and of one batch that is read, bytes of texts that a reading task holds at once, and tasks at most.
FILES, READ, TASKS = 4096, 1 << 23, 10_000


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV catalog with a header and a fixed schema (no inference pass)."""
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str, *by: str) -> None:
    """Replace what is there; with ``by``, one folder for each of its values."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(name, path below the folder, length) of the files with an extension, in order of their paths; no content is read. A folder that isn't there has none."""
    if not is_there(spark, folder):
        return spark.createDataFrame([], "name string, path string, length bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", f"^.*?{re.escape(folder.rstrip('/').split('://')[-1])}/", "")
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), below.alias("path"), "length").orderBy("path")


def read_whole_texts(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(name, content) and the columns of partition folders: one row per file, white space at both ends stripped, line ends inside kept.

    With ``deep`` folders of any name are read to their ends, and give no columns; tasks list them, so the driver holds no list of files.
    """
    folder = _listable(spark, path) if deep else None
    if folder is None:
        texts = spark.read.text(path, wholetext=True, recursiveFileLookup=deep).withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1))
    else:
        texts = _deep_texts(spark, folder)
    content = F.regexp_replace("value", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return texts.select("name", content.alias("content"), *[c for c in texts.columns if c not in ("name", "value")])


def _shown(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _listable(spark: SparkSession, path: str) -> str | None:
    """The full path of a folder that tasks can list, else None: a file, a pattern, or a file system that only Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (hadoop.exists(at) and hadoop.getFileStatus(at).isDirectory()):
        return None
    uri = hadoop.makeQualified(at).toUri()
    full = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    try:
        file_system(full)
    except (pa.ArrowException, OSError):
        return None
    return full


def _deep_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the files below a folder, those without a byte left out.

    Only the folders right below ``path`` reach the driver. A task walks some of them folder by folder and holds one folder's list and READ bytes of texts.
    """

    def listed(system, folder: str) -> tuple[list[str], list[str]]:
        found = [x for x in system.get_file_info(fs.FileSelector(folder)) if _shown(x.base_name)]
        return sorted(x.path for x in found if not x.is_file), sorted(x.path for x in found if x.is_file and x.size)

    def top(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"folder": pa.array(listed(*file_system(path))[0], pa.string())})

    folders = [r["folder"] for r in spark.range(0, 1, 1, 1).mapInArrow(top, "folder string").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        rows: list[tuple[str, bytes]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            names, values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["name", "value"])

        for k in (k.as_py() for ids in batches for k in ids.column("id")):
            left = [root if k == len(folders) else folders[k]]
            while left:
                below, files = listed(system, left.pop())
                left += below if k < len(folders) else []
                for file in files:
                    with system.open_input_stream(file) as text:
                        rows.append((file.rpartition("/")[2], text.read()))
                    held += len(rows[-1][1])
                    if held > READ or len(rows) == FILES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    places = spark.range(0, len(folders) + 1, 1, min(len(folders) + 1, TASKS))  # the last are files right in ``path``
    return places.mapInArrow(run, "name string, value binary").withColumn("value", F.col("value").cast("string"))


def write_files(rows: DataFrame, path: str) -> None:
    """One file for each row of (name, value), named ``<name>-<number>.txt`` in folders of FILES for each task; equal names stay apart.

    Tasks write them straight to the folder: a sink with a folder for each name makes the driver commit and list as many folders, and
    Hadoop starts a process for the permissions of every file on a local disk. A task that is run again writes the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        n = 0
        for batch in batches:
            for name, value in zip(batch.column("name"), batch.column("value"), strict=True):
                if n % FILES == 0:
                    folder = f"{root.rstrip('/')}/{TaskContext.get().partitionId():05d}-{n // FILES:05d}"
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name.as_py()}-{n}.txt") as out:
                    out.write(value.as_buffer())
                    out.write(b"\n")  # Spark passes over files without a byte
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select("name", "value").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_quarantine(rows: DataFrame, reason: str, good: str, bad: str) -> None:
    """Rows without a reason to one table, the others with it to another."""
    rows.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(good)
    rows.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(bad)


def read_json_lines(spark: SparkSession, path: str, schema: StructType, first: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema; blank lines don't count. With ``first``, so many lines in order of file names and of lines in a file."""
    rows = spark.read.schema(schema).json(path)
    if first is None:
        return rows
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    return rows.select("*", *place).orderBy("_file", "_block", "_line").limit(first).select(*rows.columns)


def write_json_lines(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", guard: bool = True) -> None:
    """Parquet with one folder per split; with ``guard`` an existing table is an error."""
    df.write.mode("errorifexists" if guard else "overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    """One split, other folders are pruned; an error if it isn't there."""
    rows = spark.read.parquet(path)
    known = [r[0] for r in rows.select(split).distinct().collect()]  # as many as there are splits
    if name not in known:
        raise ValueError(f"no split {name!r}; there are {sorted(map(str, known))}")
    return rows.filter(F.col(split) == name).drop(split)


def write_artefacts(df: DataFrame, path: str) -> None:
    """Artefacts as one table (id, kind, content, ok, error), not one small file each."""
    df.select("id", "kind", "content", "ok", "error").write.mode("overwrite").partitionBy("kind").parquet(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """One JSON document per row of an aggregate."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
