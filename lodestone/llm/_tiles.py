"""Rows dealt into tiles of bounded size that meet pairwise in tasks.

A tile is a hash-dealt part of a group; its rows travel as one Arrow stream in
one row, and a tile is copied once for each tile that it meets. Tiles grow with
their group up to a bound set by the vectors' length, so that copies grow with
the rows divided by the bound and no task holds more than two tiles.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from lodestone.llm._shared import small, written

#: Vector elements of a tile at most, its rows at least (if the group has them), and tiles of a group below that bound.
TILE_ELEMENTS, TILE_ROWS, TILES = 1 << 21, 1024, 8


def finite(vector: Column) -> Column:
    """Not null, and neither null nor non-finite in any component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def floats(df: DataFrame, name: str) -> Column:
    """The column's vectors as they are if of single precision, else in double precision."""
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(name).cast(ArrayType(DoubleType()))


def counted(rows: DataFrame, by: list[str], elements: int = TILE_ELEMENTS) -> DataFrame:
    """(by, tiles): how many tiles each group has; ``by`` holds ``dim``, the vectors' length."""
    each = F.least(F.ceil(F.lit(elements) / F.greatest("dim", F.lit(1))), F.greatest(F.lit(TILE_ROWS), F.ceil(F.col("_n") / TILES)))
    return written(rows.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.ceil(F.col("_n") / each).cast("int").alias("tiles")), "tiles")


def dealt(rows: DataFrame, sizes: DataFrame, by: list[str], key: str) -> DataFrame:
    """The rows with their group's ``tiles`` and their own ``tile``, by a hash of their key."""
    return rows.join(small(sizes), by).withColumn("tile", F.pmod(F.xxhash64(key), F.col("tiles")).cast("int"))


def packed(rows: DataFrame, by: list[str], make=lambda table: table) -> DataFrame:
    """(by, blob): the rows of each group, remade by ``make`` and put into one Arrow stream."""
    inner = [c for c in rows.columns if c not in by]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        content = make(table.select(inner))
        with pa.ipc.new_stream(out, content.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(content)
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in by]
        return pa.Table.from_arrays([*keys, pa.array([out.getvalue()], pa.binary())], names=[*by, "blob"])

    return rows.groupBy(*by).applyInArrow(pack, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "blob binary"]))


def opened(table: pa.Table, row: int = 0) -> pa.Table:
    return pa.ipc.open_stream(table.column("blob")[row].as_buffer()).read_all()


def matrix(table: pa.Table, name: str, rows: int, kind=np.float64) -> np.ndarray:
    """The lists of equal length in the column, a row each."""
    lists = table.column(name).combine_chunks()
    flat = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(rows, -1) if rows and len(flat) else np.zeros((rows, 0), kind)

