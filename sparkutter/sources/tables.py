"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PART_BYTES = 128 * 1024 * 1024


def row_groups(df: DataFrame) -> int:
    """How many row groups the Parquet files of ``df`` have, by their footers."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        n += reader.getRowGroups().size()
        reader.close()
    return n


def spread(df: DataFrame, heavy: bool = False) -> DataFrame:
    """``df``, read from files, dealt to all cores if it comes in fewer files than there are cores and is small.

    A small table is often one file with one row group, which one task would read and work on alone. Large tables
    stay as they are read: their files have many row groups, and moving them would cost more. For ``heavy`` work on
    each row, a large table is dealt too where its files have fewer row groups than there are cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * PART_BYTES or heavy and row_groups(df) < cores else df


def read(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"), heavy)
