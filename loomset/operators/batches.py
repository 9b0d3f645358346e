"""Batches of rows of different lengths as rectangular matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAD = 0


def collate_batches(df: DataFrame, batch: str, order: str, ids: str, pad: int = PAD) -> DataFrame:
    """``(batch, n_rows, width, n_padding, row_ids, input_ids, attention_mask)``: one matrix for each batch.

    A batch is padded to the length of its own longest row, so a batch of short rows stays
    narrow. ``input_ids`` and ``attention_mask`` hold the matrix row by row, rows in ``order``; a null or empty
    row is all padding. A batch is one group, so it must be of bounded size, as ``shuffle_batches``
    makes it; rows without a batch number are left out.
    """
    key, name = df.schema[batch].dataType.simpleString(), df.schema[order].dataType.simpleString()

    def collate(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        rows = table.column(ids).combine_chunks()
        lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n, width = len(rows), int(lengths.max())
        matrix = np.full((n, width), pad, np.int64)
        real = np.arange(width) < lengths[:, None]
        matrix[real] = rows.flatten().to_numpy(zero_copy_only=False)
        one = {
            batch: table.column(batch).slice(0, 1), "n_rows": pa.array([n]), "width": pa.array([width]),
            "n_padding": pa.array([n * width - int(lengths.sum())]),
            "row_ids": pa.array([table.column(order).to_pylist()], pa.list_(table.schema.field(order).type)),
            "input_ids": pa.array([matrix.ravel()], pa.list_(pa.int64())),
            "attention_mask": pa.array([real.astype(np.int32).ravel()], pa.list_(pa.int32())),
        }
        return pa.table(one)

    shape = (
        f"`{batch}` {key}, n_rows BIGINT, width BIGINT, n_padding BIGINT, row_ids ARRAY<{name}>, "
        "input_ids ARRAY<BIGINT>, attention_mask ARRAY<INT>"
    )
    rows = df.filter(df[batch].isNotNull()).select(batch, order, df[ids].cast("array<bigint>").alias(ids))
    return rows.groupBy(batch).applyInArrow(collate, shape)
