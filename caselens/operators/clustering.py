"""Groups of rows handed to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_groups(rows: DataFrame, key: str, order: list[str], f: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``f`` applied to the rows of each key, sorted by ``order``; for very many small groups.

    Rows are partitioned and sorted by key and streamed through one Python call per partition, which holds one group
    at a time; a pandas frame per group would cost more than the work on it.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    at = rows.columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if held and row[at] != held[0][at]:
                    out += f(held)
                    held = []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(f(held), columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
