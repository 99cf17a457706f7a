"""Helpers shared by the training-data operators: reading, shared storage, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-quire-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str, by: Iterable[str] = ()) -> DataFrame:
    """`df` as a Parquet table in the shared folder, in folders by `by`: later work starts from the files, so what was shuffled
    for them is removed at once and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(table_: DataFrame) -> None:
    """Deletes the files of a table of `written` that nothing reads any more."""
    spark = table_.sparkSession
    for folder in {file.rpartition("/")[0] for file in table_.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the decimal digits of an id, which decides folds."""
    return F.crc32(doc_id.cast("string"))


def own_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that a caller's other columns can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that long texts are not all decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_lower(text: str | None) -> list[bytes]:
    """UTF-8 words with only A-Z lower-cased; bytes.split() cuts at ASCII white space alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
