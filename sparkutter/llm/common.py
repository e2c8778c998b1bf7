"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

_folders: set[str] = set()
_open = threading.local()  # scopes: of each settled() under way, what has been written in it


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named: in tests, a folder of our own; else an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not jsc.isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkutter-"))
    return jsc.getCheckpointDir().get()


def delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def own_folder(spark: SparkSession) -> str:
    """A folder for this application's intermediate tables, which goes when the application ends."""
    jsc = spark.sparkContext._jsc.sc()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sparkutter-{jsc.applicationId()}"
    if path not in _folders:
        _folders.add(path)
        jvm, conf = spark.sparkContext._jvm, jsc.hadoopConfiguration()

        def remove() -> None:
            try:
                delete(jvm, conf, path)
            except Exception as e:  # the JVM may be gone before us
                print(f"sparkutter: {path} is left: {type(e).__name__}", file=sys.stderr)

        atexit.register(remove)
    return path


#: Rows that Python gets at a time: with texts of 100 KB each, a batch is still about 100 MB.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows, not by bytes, so long texts need fewer rows than Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    It cuts the lineage as checkpoint() does, but the files are columnar and compressed, later reads prune
    columns, and nothing is lost with an executor.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table for each of its files, at least.
FILE_ROWS = 100_000


def gathered(df: DataFrame, rows: int, most: int = FILE_ROWS) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in one part for each core, or for each ``most`` of them if those are more.

    Without an exchange, and every row stays. A small table else gets a file for each of many shuffle partitions,
    and a local file costs its executor two shell commands. Not for parts that Python is still to work out.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, materialized; what it materialized on its way is deleted."""
    _open.scopes = [*getattr(_open, "scopes", []), []]
    try:
        df = make()
    finally:
        *_open.scopes, inner = _open.scopes
    out = materialize(df)
    spark = df.sparkSession
    for path in inner:
        delete(spark.sparkContext._jvm, spark.sparkContext._jsc.sc().hadoopConfiguration(), path)
    return out


#: Beside any columns of the documents.
ROW, SALT = "__sparkutter_row", "__sparkutter_salt"


def content_key(id_col: str, text_col: str) -> Column:
    """A key that rows share if, and (but for collisions of MD5) only if, both their ids and their texts are the same."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5(F.col(text_col)), F.lit("-")))


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each combination of ``keys`` that occurs.

    An inner join that a hot key does not put into one task: ``salt`` divides a key's rows, and the facts go to each
    part that occurs. Give it written rows, as they are read twice.
    """
    salted = rows.withColumn(SALT, salt)
    parts = salted.groupBy(*keys, SALT).agg(F.count(F.lit(1)).alias(f"{SALT}_n")).drop(f"{SALT}_n")
    return salted.join(parts.join(facts, keys), [*keys, SALT]).drop(SALT)


def words_of(text: Column) -> Column:
    """The words of a text (null: none), without empty strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return read(spark, sf_dir, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
