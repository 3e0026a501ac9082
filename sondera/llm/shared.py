"""Tables and binary files in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows go to Python in batches of about so many bytes, however long their texts are.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where
    that is unset, which is the case in single-machine tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sondera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own under the shared root; made when written to."""
    root = shared_root(spark)
    if not urlparse(root).scheme:
        root = "file://" + root
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts
    the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.sondera_path = path
    return back


def remove(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "sondera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, in a session whose batches are bounded by bytes and not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) == "67108864b":  # the default: nobody has set another
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def tidy(work):
    """``work`` over the batches of a task; at its end what it has freed goes back to the
    system, as the worker process stays for other tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def id_and_text(documents: DataFrame) -> DataFrame:
    """The two columns that operators on texts read."""
    return bounded(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, on any executor."""
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, chunks) -> tuple[str, int]:
    """Write the byte strings of ``chunks`` to a file with a fresh name.

    Every attempt of a task writes a file of its own.  Readers follow the
    manifest rows that Spark has committed, so a file of a lost attempt is
    never read.
    """
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    n = 0
    with fs.open_output_stream(f"{root}/{name}") as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return f"{folder}/{name}", n


def read_file(uri: str):
    """An open random-access file."""
    fs, path = open_fs(uri)
    return fs.open_input_file(path)
