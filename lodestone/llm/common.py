"""What the operators of this package share: table reading, settling of intermediate tables, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20
#: A word is a run of anything but these white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the data folder, which may lie in any store that Spark reads."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is named, one on this machine, for a local master only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        sc.setCheckpointDir(found)
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where df has columns of these names already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _file_system(df: DataFrame, path: str):
    """Hadoop's path, and the file system that holds it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage and outlives lost executors. The files
    go when discard() is called, or at the end of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, store = _file_system(df, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more, so that the shared folder holds no more than a job needs."""
    for df in settled:
        at, store = _file_system(df, df._settled_at)
        store.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Keeps an Arrow batch of long texts small, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def words(text):
    """Words of a text column as an array without empty strings; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def plain(text):
    """Lower-cased words of letters and digits only, one blank between them; null gives the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def in_python(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with small batches. function: from an iterator of record batches to one of record batches."""
    bounded_batches(df.sparkSession)

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns the memory that this worker has freed to the system: workers stay while others and the JVM need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let(value, then):
    """then(value), where value is worked out once a row: an expression inside a lambda is else worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
