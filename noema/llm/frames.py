"""Helpers shared by the operators: Arrow maps, blocks of rows, and cut lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that one block of rows holds on average.
BLOCK_CHARS = 16_000_000
#: Bytes of a batch that a function gets at a time.
PIECE_BYTES = 6_000_000


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under fixed names, so extra columns can't clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def document_name(docs: DataFrame) -> tuple[Column, Column]:
    """What names a document: a hash of its id and text, and the low 32 bits of its id (0 for null)."""
    doc_id = docs["doc_id"].cast("long")
    return F.xxhash64(doc_id, docs["text"].cast("string")), F.coalesce(F.shiftright(F.shiftleft(doc_id, 32), 32).cast("int"), F.lit(0))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for a function of a piece of a batch; None stands for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows // (batch.nbytes // PIECE_BYTES + 1))
            for k in range(0, batch.num_rows, step):
                if (out := fn(batch.slice(k, step))) is not None:
                    yield out
        pa.default_memory_pool().release_unused()  # workers live on for other tasks

    return df.mapInArrow(run, schema)


def filter_rows(docs: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], helper: str = "") -> DataFrame:
    """Rows for which ``fn`` of a batch is true, with all columns (but for ``helper``) as they are; no shuffle."""
    kept = [c for c in docs.columns if c != helper]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select(kept).filter(pa.array(fn(batch)))

    return map_batches(docs, run, docs.select(*kept).schema)


def block_count(df: DataFrame, text_col: str = "text", chars: int = BLOCK_CHARS) -> int:
    """How many blocks hold the rows at about ``chars`` characters each; one number reaches the driver."""
    total = df.agg(F.coalesce(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 16), F.lit(0))).first()[0]
    return max(1, -(-int(total) // chars))


def in_blocks(df: DataFrame, blocks: int) -> DataFrame:
    """Rows with a block number from a hash of the whole row: the rows of one key, source or copy group spread over all blocks."""
    return df.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


def ordered_rows(table: pa.Table) -> tuple[list[int | None], list[str | None]]:
    """Ids and texts of a block in an order that depends on the rows alone: each pass over a block numbers its rows alike."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    return [ids[i] for i in order], [texts[i] for i in order]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; only a local session may do without that setting and gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "noema-checkpoints"))
    return df.checkpoint(eager=True)


def crc_remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of ragged rows, with the end of the last one."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
