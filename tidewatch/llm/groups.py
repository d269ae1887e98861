"""Linking rows that share a key, with the keys streamed in sorted order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def link_by_key(
    rows: DataFrame, similar: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, sketch: bool = False, place: bool = False, spare: int = 0
) -> DataFrame:
    """Edges ``a, b`` between nodes that share a key.

    ``rows`` has ``key`` and ``node`` (long), with ``sketch`` a 64-bit sketch and with
    ``place`` a long that the edges carry on, as ``pa`` and ``pb`` beside the key.
    Without ``similar`` every node of a key is linked to the key's first node. With
    it a node is linked to the earliest node of its key whose sketch is similar,
    among those that were similar to none before. A task streams its keys in
    sorted order and holds the leaders of one open key, never pairs.

    With ``spare`` that many of the lowest bits are zero in all keys. The highest
    bits of the node take their place, and one number is sorted instead of two.
    """
    names = ["key", "node"] + ["sketch"] * sketch + ["place"] * place
    schema = "a long, b long" + ", key long, pa long, pb long" * place
    order = [F.col("key").bitwiseOR(F.shiftright("node", 64 - spare) + F.lit(1 << spare - 1))] if spare else ["key", "node"]
    dealt = rows.select(*names).repartition("key").sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda batches: _stream(batches, similar, place), schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches put together until they have enough rows for work on whole arrays."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _stream(batches: Iterator[pa.RecordBatch], similar, place: bool) -> Iterator[pa.RecordBatch]:
    open_rows = None  # leaders of the key that the part before ended in
    for part in gathered(batches):
        rows = [part.column(c).to_numpy() for c in part.column_names]
        if open_rows is not None:
            rows = [np.concatenate(pair) for pair in zip(open_rows, rows, strict=True)]
        if ((rows[0][1:] == rows[0][:-1]) & (rows[1][1:] < rows[1][:-1])).any():
            rows = [x[order] for order in [np.lexsort((rows[1], rows[0]))] for x in rows]  # nodes that share their highest bits
        keys, nodes = rows[0], rows[1]
        alone = np.concatenate(([True], keys[1:] != keys[:-1])) & np.concatenate((keys[1:] != keys[:-1], [True]))
        leads = np.zeros(len(keys), bool)
        left = np.flatnonzero(~alone | (keys == keys[-1]))
        found = []
        while len(left):
            # The first row left of each key leads; the rows like it are linked to it and leave.
            first = np.concatenate(([True], keys[left[1:]] != keys[left[:-1]]))
            lead = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            leads[left[first]] = True
            near = first | (similar(rows[2][left].view(np.uint64), rows[2][lead].view(np.uint64)) if similar else True)
            other = near & (nodes[lead] != nodes[left])
            found.append(np.stack([lead[other], left[other]]))
            left = left[~near]
        a, b = np.concatenate(found, axis=1)
        last = np.flatnonzero(leads & (keys == keys[-1]))
        open_rows = [x[last] for x in rows]
        if not len(a):
            continue
        if place:
            columns = {"a": nodes[a], "b": nodes[b], "key": keys[a], "pa": rows[-1][a], "pb": rows[-1][b]}
        else:
            pairs = np.unique(np.stack([nodes[a], nodes[b]]), axis=1)
            columns = {"a": pairs[0], "b": pairs[1]}
        yield pa_batch(columns)


def pa_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.values()], list(columns))
