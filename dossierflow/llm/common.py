"""What the text operators share: reading tables, mapping texts in bounded batches, cutting lineage."""

from __future__ import annotations

import binascii
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import shared_folder

#: Texts are handed to an operator's function in slices of about this many bytes.
SLICE_BYTES = 4_000_000
#: Places in a bitmap that is broadcast.
BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of bounded volume of texts or lists of numbers (one text is never cut)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(sizes, 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def per_text(
    df: DataFrame,
    factory: Callable[[], Callable[[list[str]], list[list]]],
    fields: list[T.StructField],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row (id, *fields) for each row of df.

    factory runs once in each task and returns a function from a list of texts (a null
    text arrives as None) to one list of values for each field. Other columns of df are
    never read, so their names cannot clash.
    """
    schema = T.StructType([df.schema[id_col], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = factory()
        for part in slices(batches):
            found = function(part.column(1).to_pylist())
            columns = [part.column(0)] + [
                v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(found, list(arrow)[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which free removes."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    # small row groups: a task holds one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Removes tables that stored wrote and that nothing reads any more."""
    for df in tables:
        jvm, folder = df.sparkSession._jvm, df.inputFiles()
        if folder:
            path = jvm.org.apache.hadoop.fs.Path(folder[0].rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _word(c: F.Column) -> F.Column:
    return F.shiftright(c, 6).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int")


def _bit(c: F.Column) -> F.Column:
    return c.bitwiseAND(F.lit(63)).cast("int")


def perhaps(df: DataFrame, column: str, wanted: DataFrame, flag: str | None = None) -> DataFrame:
    """Rows of df whose column (a hash) may be in the first column of wanted, or df with that as a column named flag.

    What is broadcast is a bitmap of at most BITS bits, whatever wanted holds: a filter that lets all
    of wanted pass, to go before an exact join.
    """
    name = F.col(wanted.columns[0])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(name))
    words = wanted.select(_word(name).alias("__w"), one.alias("__x")).groupBy("__w").agg(F.bit_or("__x").alias("__x"))
    joined = df.join(F.broadcast(words), _word(F.col(column)) == F.col("__w"), "left" if flag else "inner")
    there = F.call_function("getbit", F.coalesce("__x", F.lit(0).cast("long")), F.coalesce(_bit(F.col(column)), F.lit(0))) == 1
    return (joined.withColumn(flag, there) if flag else joined.filter(there)).drop("__w", "__x")


def fold(column: str | F.Column = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % 3


def held_out(doc_id: object) -> bool:
    return binascii.crc32(str(doc_id).encode()) % 3 == 1
