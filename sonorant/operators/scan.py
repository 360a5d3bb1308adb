"""Ordered scans over chunk or frame rows, with state carried from row to row.

Rows of a key are brought together and sorted by Spark (the sort spills), and then stream through Python batch by batch:
a task holds one state and one batch, so a recording may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scan(Protocol):
    """State for one key."""

    def push(self, row: dict) -> list[dict]:
        """The rows that follow from one more input row."""

    def close(self) -> list[dict]:
        """The rows that are left when the key ends."""


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Scan], schema: str) -> DataFrame:
    """Run a scan over each key's rows in order. Results carry whatever columns the scan returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, scan, out, names = None, None, [], [c.strip().split()[0] for c in _columns(schema)]
        for b in batches:
            for row in b.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    if scan is not None:
                        out += scan.close()
                    current, scan = key, make()
                out += scan.push(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if scan is not None and (out := scan.close()):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    """The columns of a flat DDL schema (commas inside <> do not part)."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]
