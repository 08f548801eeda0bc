"""What the corpus operators share: the shared folder, written tables, id-ordered dealing, Arrow helpers."""

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most ranges that dealing by id makes; what is broadcast of them stays under a megabyte.
MOST_RANGES = 10_000
#: Rows that dealing by id wants in a range.
ROWS_A_RANGE = 8_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a
    temporary folder; a cluster gets an error, as its executors would each write to a disk of their own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sitebraid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder under the shared one; that folder goes when the program ends."""
    own = f"{shared_folder(spark)}/sitebraid/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        drop_path(spark, path)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of written tables through Hadoop's file system, wherever it is."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as long and the text with null as empty; other columns go, whatever their names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 8_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of at most so many rows and, unless one text alone is longer, bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
        sizes = np.concatenate([[0], np.cumsum(lengths)])
        start = 0
        while start < batch.num_rows:
            stop = min(batch.num_rows, start + rows)
            stop = min(stop, max(start + 1, int(np.searchsorted(sizes, sizes[start] + chars, "right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop


def as_batch(columns: dict, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema([(f.name, f.type) for f in fields]))


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 256, text: str = "text") -> DataFrame:
    """function(slice) gives columns by name; applied to every slice on the executors."""
    struct = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows, text=text):
            yield as_batch(function(part), struct)

    return df.mapInArrow(run, struct)


@dataclass(frozen=True)
class Ranges:
    """Ranges of ids, ascending: those of null ids, then one up to each cut (a cut that repeats is an id that fills several), then the rest."""

    rows: int
    nulls: int
    cuts: np.ndarray

    @property
    def n(self) -> int:
        return self.nulls + len(self.cuts) + 1

    @property
    def hot(self) -> bool:
        """Whether an id or the null ids fill more than one range."""
        return self.nulls > 1 or bool((np.diff(self.cuts) == 0).any())


def ranges_of(ids: DataFrame, id_col: str) -> Ranges:
    """Ranges of about ROWS_A_RANGE rows each, MOST_RANGES at most. Gathers quantiles of the ids only (a bounded sketch)."""
    rows, known = ids.agg(F.count("*"), F.count(id_col)).first()
    n = min(MOST_RANGES, max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_RANGE)))
    nulls = -(-(rows - known) * n // max(rows, 1))
    n -= nulls
    if not known or n < 2:
        return Ranges(rows, nulls, np.zeros(0, "i8"))
    cuts = ids.where(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 2 * n)).alias("q")).first()["q"]
    return Ranges(rows, nulls, np.sort(np.asarray(cuts or [], "i8")))


def range_numbers(ids: pa.Array, ties: np.ndarray, ranges: Ranges) -> np.ndarray:
    """The range of each id; an id (or null) that fills several is dealt over them by ties, in their order."""
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("i8")
    low = np.searchsorted(ranges.cuts, values, "left") + ranges.nulls
    many = np.maximum(1, np.searchsorted(ranges.cuts, values, "right") + ranges.nulls - low)
    low[null], many[null] = 0, max(1, ranges.nulls)
    share = ties.astype("f8") / 2.0**64 + 0.5
    return (low + np.minimum((share * many).astype("i8"), many - 1)).astype("i4")


def range_of(id_col: str, tie_col: str, ranges: Ranges) -> Column:
    """The number of the range that an id falls in, ascending; null ids come first."""

    @F.arrow_udf("int")
    def number(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(range_numbers(ids, ties.to_numpy(zero_copy_only=False), ranges), pa.int32())

    return number(F.col(id_col), F.col(tie_col))


def ranged(texts: DataFrame, ranges: Ranges) -> DataFrame:
    """texts (doc_id, text) with tie, which orders rows of one id (a hash of the text where an id is that frequent, else 0), and range."""
    tied = texts.withColumn("tie", F.xxhash64("text") if ranges.hot else F.lit(0).cast("long"))
    return tied.withColumn("range", range_of("doc_id", "tie", ranges))
