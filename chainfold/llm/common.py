"""Shared helpers: table access, the shared scratch folder, and small text expressions."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A maximal run of characters other than ASCII white space.
WHITE_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII characters that are neither digits nor letters; what lies between them are words.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Python workers get this package's functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder that is removed at exit; a cluster
    without the setting is refused, since a machine-local folder would lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="chainfold-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_roots: list[tuple[SparkSession, str]] = []


def clean_up() -> None:
    """Remove every scratch table of this process; results that still read them are lost. Runs at exit."""
    while _roots:
        _delete(*_roots.pop())


atexit.register(clean_up)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than the tasks it ran.

    They go when they are dropped, or all of them with clean_up().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))
        self.paths: dict[str, str] = {}
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made}-{name.replace(' ', '_')}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        if path := self.paths.pop(name, None):
            _delete(self.spark, path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def word_array(lowered: Column) -> Column:
    return F.filter(F.split(lowered, WORD_BREAK), lambda w: w != "")


#: Arrow batches to Python workers hold no more than this many bytes.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Lower the session's limit on Arrow batches, so that long texts cannot fill a worker's memory.

    Plans read the setting when they run, after the operator has returned, so it is not raised again.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdecimal() or int(now) > limit:
        spark.conf.set(key, str(limit))


def add_columns(df: DataFrame, inputs: list[str], make: Callable, fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed in Arrow batches: make() gives, once a task, a function of lists that returns lists.

    Nothing outlives a batch, so memory is bounded by a batch whatever the size of the table.
    """
    bound_batches(df.sparkSession)
    added = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in kept]
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            made = compute(*[batch.column(batch.schema.get_field_index(i)).to_pylist() for i in inputs])
            old = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*old, *(pa.array(v, type=t) for v, t in zip(made, types, strict=True))], [*names, *added.names])

    return df.mapInArrow(run, T.StructType([*kept, *added.fields]))


def pack(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all others but the text in one struct, so that no name can clash with a column made later."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))


def unpack(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order, from what pack() made."""
    return df.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
