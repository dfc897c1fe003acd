"""Rows of a key handed to Python together, one key after another, without holding a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptoria.llm.kernels import released

#: Bytes of a group's rows beyond which no column may have 32-bit offsets.
WIDE_BYTES = 1 << 30


def over_groups(df: DataFrame, key: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, partitions: int, many: bool = False) -> DataFrame:
    """``work`` on the rows of each value of the long column ``key``; at most one key's rows are held beyond a batch.

    With ``many``, ``work`` gets all the keys that end in a batch at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            if many and len(cuts) > 3:
                cuts = [0, *([cuts[1]] if held and keys[0] == now else []), cuts[-2], cuts[-1]]
            for i, j in zip(cuts, cuts[1:]):
                if held and keys[i] != now:
                    if (out := work(joined(held))) is not None:
                        yield out
                    held = []
                now = keys[i]
                held.append(batch.slice(i, j - i))
        if held and (out := work(joined(held))) is not None:
            yield out

    return df.repartition(partitions, key).sortWithinPartitions(key).mapInArrow(released(run), schema)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows; beyond WIDE_BYTES, bytes and texts get 64-bit offsets, as 32-bit ones would split the rows."""
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches)
    if table.nbytes > WIDE_BYTES:
        wide = {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}
        table = table.cast(pa.schema([f.with_type(wide.get(f.type, f.type)) for f in table.schema]))
    parts = table.combine_chunks().to_batches()
    if len(parts) != 1:
        raise ValueError(f"a group's {table.nbytes} bytes can't be put together")
    return parts[0]
