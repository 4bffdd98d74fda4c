"""Shared pieces of the training-data operators: tables, Arrow passes, stage tables, hash remainders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberfield.session import checkpoint_folder

#: Rows handed to a Python worker at once are cut to about this many bytes of text.
SLICE_BYTES = 8 << 20

Batch = pa.RecordBatch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, null as empty. ``bytes.lower()`` and ``bytes.split()`` are just the ASCII ones wanted."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batches: Iterator[Batch], text_at: int) -> Iterator[Batch]:
    """Cut incoming batches so that a slice holds a bounded number of text bytes (or one row)."""
    for batch in batches:
        column = batch.column(text_at)
        rows = batch.num_rows
        if column.nbytes <= SLICE_BYTES or rows < 2:
            if rows:
                yield batch
            continue
        step = max(1, rows * SLICE_BYTES // column.nbytes)
        for at in range(0, rows, step):
            yield batch.slice(at, min(step, rows - at))


def map_texts(df: DataFrame, text: str, factory: Callable[[], Callable[[Batch], dict]], added: str) -> DataFrame:
    """Arrow pass over all rows: input columns stay, ``factory()`` (once per task) turns a slice into the added ones."""
    at = df.columns.index(text)
    own = df.schema
    schema = StructType.fromDDL(added)
    names = [f.name for f in schema.fields]
    full = StructType([*own.fields, *schema.fields])
    kinds = _arrow_types(schema)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        make = factory()
        for batch in slices(batches, at):
            made = make(batch)
            yield Batch.from_arrays(
                [*batch.columns, *(_array(made[n], kinds[n]) for n in names)], names=[*batch.schema.names, *names]
            )

    return df.mapInArrow(run, full)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_types(schema: StructType) -> dict[str, pa.DataType]:
    return {f.name: f.type for f in to_arrow_schema(schema)}


class Stages:
    """Tables in the shared checkpoint folder that cut lineage between the passes of one operator.

    ``write`` materialises a frame and reads it back; ``drop`` removes tables that no later pass reads. What the
    returned frame of an operator still reads stays until the folder's own retention removes it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # by id, with the frame so that its id stays its own
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def folder(self, name: str) -> str:
        """A place for files of this operator that are not tables."""
        return f"{self.root}/{name}"

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self.paths.pop(id(frame), (None, None))
            if path:
                self.remove(path)

    def drop_all(self) -> None:
        """Remove everything at once: what was made from these tables is written elsewhere by then."""
        self.paths.clear()
        self.remove(self.root)

    def remove(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: Words of 64 bits that are broadcast: marks of hashed values are folded to so many, marks of row numbers are sent if there are no more.
SIEVE_WORDS, ROW_WORDS = 1 << 18, 1 << 20


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def _marked(df: DataFrame, marks: DataFrame, word: Column, at: Column) -> DataFrame:
    met = df.withColumn("_word", word).join(marks, "_word").where(F.col("_bits").bitwiseAND(_bit(at)) != 0)
    return met.select(*df.columns)


def _marks(values: DataFrame, word: Column, at: Column) -> DataFrame:
    return values.groupBy(word.alias("_word")).agg(F.bit_or(_bit(at)).alias("_bits"))


def sieved(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose 64-bit hash ``name`` may be among ``keys``, for a join to follow: none of these is missing, and of the others few pass
    while keys are fewer than the bits of the sieve. What is sent to the tasks has a fixed size, and ``df`` is not shuffled."""
    word, at = F.col(name).bitwiseAND(F.lit(SIEVE_WORDS - 1)), F.shiftrightunsigned(name, 58)
    return _marked(df, F.broadcast(_marks(keys, word, at)), word, at)


def numbered(df: DataFrame, rows: DataFrame, stages: Stages, name: str = "row") -> DataFrame:
    """Exactly the rows of ``df`` whose number, distinct and dense but for gaps between tasks, is in ``rows``; ``df`` is not shuffled for it."""
    word, at = F.shiftright(name, 6), F.col(name).bitwiseAND(F.lit(63))
    marks = stages.write(_marks(rows, word, at))
    return _marked(df, F.broadcast(marks) if marks.count() <= ROW_WORDS else marks, word, at)
