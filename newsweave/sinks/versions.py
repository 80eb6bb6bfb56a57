"""Tables kept as numbered folders, so that a table can be rewritten from
itself: readers use the newest complete folder, writers add the next one. A
folder may be cut into buckets; then readers use the newest one of each bucket."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PREFIX = "version="
# A row's bucket as a column, and the name of its folder.
BUCKET, FOLDER = "_bucket", "bucket"
# The file in a version's folder that says what it holds. Spark skips such names.
NOTE = "_table.json"


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _folder(spark, path)
    return files.exists(target)


def _noted(spark: SparkSession, folder: str) -> dict | None:
    """What was noted about a version: its buckets' number, whether it stands alone, and
    its schema. The note is written last; a version without it is not complete."""
    files, target = _folder(spark, f"{folder}/{NOTE}")
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _note(spark: SparkSession, folder: str, note: dict) -> None:
    files, target = _folder(spark, f"{folder}/{NOTE}")
    stream = files.create(target, False)
    try:
        stream.write(bytearray(json.dumps(note).encode()))
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions below ``root``, in order."""
    files, target = _folder(spark, root)
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    numbers = [int(n[len(PREFIX):]) for n in names if n.startswith(PREFIX)]
    return sorted(n for n in numbers if path_exists(spark, f"{root}/{PREFIX}{n}/{NOTE}"))


@dataclass(frozen=True)
class Current:
    """The newest state of a table: its version, number of buckets (0 if it has none),
    the folders of its buckets and their bytes and files, and its schema."""

    version: int
    buckets: int
    folders: dict[int, str]
    sizes: dict[int, tuple[int, int]]
    schema: StructType

    def read(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows, or those of some buckets only; None when none of these is there.
        The schema is given, so no footer is read for it; a column that an older
        bucket lacks is null there."""
        paths = [p for b, p in sorted(self.folders.items()) if buckets is None or b in buckets]
        return spark.read.schema(self.schema).parquet(*paths) if paths else None


def current(spark: SparkSession, root: str) -> Current | None:
    """The newest version below ``root`` and, back to the last version that stands
    alone, the newest folder of each bucket."""
    numbers = versions(spark, root)
    if not numbers:
        return None
    newest = _noted(spark, f"{root}/{PREFIX}{numbers[-1]}")
    folders: dict[int, str] = {}
    sizes: dict[int, tuple[int, int]] = {}
    for number in reversed(numbers):
        folder = f"{root}/{PREFIX}{number}"
        files, target = _folder(spark, folder)
        parts = [folder] if not newest["buckets"] else [
            status.getPath().toString() for status in files.listStatus(target) if status.getPath().getName().startswith(f"{FOLDER}=")]
        for part in parts:
            bucket = int(part.rpartition("=")[2]) if newest["buckets"] else 0
            if bucket not in folders:
                summary = files.getContentSummary(_folder(spark, part)[1])
                folders[bucket], sizes[bucket] = part, (summary.getLength(), summary.getFileCount())
        if _noted(spark, folder)["alone"]:
            break
    return Current(numbers[-1], newest["buckets"], folders, sizes, StructType.fromJson(newest["schema"]))


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest rows below ``root``, or None when there is no version yet."""
    found = current(spark, root)
    if found is None:
        return None
    rows = found.read(spark)
    return rows if rows is not None else spark.createDataFrame([], found.schema)


def write_next(df: DataFrame, root: str, expected: int, schema: StructType, buckets: int = 0, alone: bool = True) -> int:
    """Write ``df`` as the version after ``expected``. Two writers of the same number:
    the second fails. With ``buckets`` the column BUCKET says which one a row is in;
    unless the version stands ``alone``, buckets it lacks stay those of earlier ones."""
    folder = f"{root}/{PREFIX}{expected + 1}"
    writer = df.write.mode("errorifexists")
    if buckets:
        writer = df.withColumnRenamed(BUCKET, FOLDER).write.mode("errorifexists").partitionBy(FOLDER)
    writer.parquet(folder)
    _note(df.sparkSession, folder, {"buckets": buckets, "alone": alone, "schema": schema.jsonValue()})
    return expected + 1
