"""What the training-data operators share: shared-folder tables, skew-proof joins and ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group that holds more than one row in HOT_SHARE is broadcast, so a broadcast has at most HOT_SHARE rows.
HOT_SHARE = 1000
#: Rows that one bucket of a large group is meant to hold.
BUCKET_ROWS = 4096
#: White space of the word and normalisation rules: blank and the five ASCII control characters from tab to CR.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir; a temporary one only for a local master without it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    for session, path in _made:
        if session is spark and "/folio-local-" in path:
            return path
    path = tempfile.mkdtemp(prefix="folio-local-")
    _made.append((spark, path))
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
        pass


@atexit.register
def release() -> None:
    """Deletes the tables written by materialize(); results that read them must have been consumed."""
    while _made:
        _drop(*_made.pop())


def made() -> list[str]:
    """The folders that materialize() has written and that are still there."""
    return [path for _, path in _made]


def discard(paths: Sequence[str]) -> None:
    """Deletes some of made(); results that read them must have been consumed."""
    gone = set(paths)
    for session, path in [m for m in _made if m[1] in gone]:
        _made.remove((session, path))
        _drop(session, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind as it takes to differ from all columns of df, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written once, so that all that read it see the same numbers, and that column's name."""
    row = unused(docs, "row_no")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def row_number(row_col: str | None) -> Column:
    """The given numbers of rows, or new ones, which hold only within one reading of the table."""
    return F.col(row_col) if row_col else F.monotonically_increasing_id()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of many rows with one row for each group, of which one may own a third of all rows.

    groups has the key columns (never null, unique), the number of rows of the group in column `size`, and a
    payload. Groups of over total / HOT_SHARE rows are HOT_SHARE at most by counting, whatever the data, so they
    are broadcast; the others meet their rows in a shuffle that has no large key. Both inputs should be
    materialized, as each is read twice.
    """
    least = max(1, -(-total // HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = groups.filter(F.col(size) <= least)
    keys = list(keys)
    out = rows.columns + [c for c in groups.columns if c not in keys]
    easy = rows.join(hot, keys)
    rest = rows.join(F.broadcast(groups.filter(F.col(size) > least).select(*keys)), keys, "left_anti").join(cold.hint("shuffle_merge"), keys)
    return easy.select(*out).unionByName(rest.select(*out))


def unit(*of: Column) -> Column:
    """A pseudo-random double in [0, 1) that is the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)).cast("double")
