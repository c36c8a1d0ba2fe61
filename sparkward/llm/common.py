"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Output rows are handed back to Spark in batches of at most so many rows or bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(value: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if value is None else value.encode("utf-8")


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, one at a time; null counts as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


class Rows:
    """Collects rows column by column and gives them out as bounded Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.bytes = schema, [[] for _ in schema], 0

    def add(self, *values, size: int = 0) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += size

    @property
    def full(self) -> bool:
        return len(self.columns[0]) >= BATCH_ROWS or self.bytes >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def carried(out: pa.RecordBatch, batch: pa.RecordBatch, first: int, start: int) -> pa.RecordBatch:
    """out, whose rows stand for those of batch from start on, with the columns of batch from first on."""
    names = [*out.schema.names, *batch.schema.names[first:]]
    return pa.RecordBatch.from_arrays([*out.columns, *(c.slice(start, out.num_rows) for c in batch.columns[first:])], names=names)


def carried_sql(df: DataFrame, carry: tuple[str, ...]) -> str:
    """The carried columns for a schema in SQL."""
    return "".join(f", `{name}` {df.schema[name].dataType.simpleString()}" for name in carry)


def written(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder, which goes when the driver ends or by discard()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = jvm_path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that written() gave, once nothing that is still to run reads it."""
    df.written_to.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df.written_to, True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with rid, a number without repeats that orders as doc_id does.

    That is doc_id itself where it can be. Where ids are null or repeat, rows are numbered in order
    of doc_id (null first), then text, after a sort, and own_id marks that.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("rid", F.col("doc_id"))
    return written(docs.orderBy("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).withColumn("own_id", F.lit(True)))


def digest64(data: bytes, salt: bytes = b"") -> int:
    """A signed 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=salt).digest(), "little", signed=True)


def of_process(key: tuple, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in a worker process and held there for its later tasks, until another key comes."""
    held = vars(sys.modules.setdefault("sparkward_of_process", ModuleType("sparkward_of_process"))).setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def release_process() -> None:
    """Lets go of what of_process() holds, for operators that need the memory."""
    vars(sys.modules.get("sparkward_of_process", ModuleType("none"))).get("held", {}).clear()


#: The table of crc32 in DuckDB's SQL, in one row.
CRC32_TABLE_SQL = """(SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0), lambda c, x:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc32_sql(text: str) -> str:
    """The crc32 of an expression of DuckDB's SQL, next to a column crcs from CRC32_TABLE_SQL."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * k - 1, 2) AS BIGINT)"
    steps = f"[4294967295] || list_transform(range(1, octet_length(encode({text})) + 1), lambda k: {byte})"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295)"
