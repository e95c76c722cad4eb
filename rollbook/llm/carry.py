"""Columns of an input that pass through a batch function beside its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import Block, blocks


def per_block(docs: DataFrame, text: str, columns: list[str], schema: str, run: Callable[[Block], dict]) -> DataFrame:
    """``columns`` of ``docs`` and, for each text, the values that ``run`` gives for its block.

    ``run`` returns an array for each field of ``schema``. Carried columns have
    other names inside, so that a name of ``schema`` may also be one of theirs.
    Returned are the fields of ``schema`` and the carried columns as ``__0``,
    ``__1`` and so on, in the order given.
    """
    chosen = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)), F.col(f"`{text}`").alias("__text"))
    head = "".join(f"__{i} {f.dataType.simpleString()}, " for i, f in enumerate(chosen.schema.fields[:-1]))
    n = len(columns)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("__text")):
                own = batch.slice(block.first, block.n)
                out = run(block)
                yield pa.RecordBatch.from_arrays(
                    [own.column(i) for i in range(n)] + [v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()],
                    [f"__{i}" for i in range(n)] + list(out),
                )

    return chosen.mapInArrow(over, head + schema)


def named(result: DataFrame, columns: list[str], own: list[str]) -> DataFrame:
    """The carried columns under their names, then the fields ``own``."""
    return result.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(columns)), *own)
