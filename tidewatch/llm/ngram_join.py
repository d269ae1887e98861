"""Operator 8, n-gram Jaccard join by signature trees.

Documents whose shingle sets are equal become one node at once. Two different
sets with Jaccard similarity of at least num / den differ in so few shingles that,
dealt by hash into one part more than that, they have a part in common; documents
of near sizes are dealt alike, and those that share a part form candidate
clusters. This loses no pair. Inside the clusters signature trees (``setjoin``)
find and verify the links, and union-find closes them.

A null text, or one without words, has an empty set and is linked with nothing.
Rows that repeat a doc_id are judged by their own text; a null doc_id never
becomes a component's id unless the component has no other. Sets and parts are
told apart by 64-bit hashes. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import arrays as A
from tidewatch.llm.frames import components, first_rows, keyed, same_text, unkeyed
from tidewatch.llm.groups import link_by_key
from tidewatch.llm.setjoin import verified_components
from tidewatch.session import materialize

NUM, DEN, WIDTH = 90, 100, 3
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and their number."""
    data, starts = A.text_bytes(column)
    data = A.lower_ascii(data)
    begin, end = A.runs(_WORD[data], starts)
    words = A.slice_hashes(data, begin, end)
    counts = np.bincount(A.row_of(begin, starts), minlength=len(starts) - 1).astype(np.int64)
    return A.distinct_in_rows(*A.shingles(words, counts, width))


def set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each set, the same whatever the order."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(A.mix(values + np.uint64(5)), dtype=np.uint64)))
    ends = np.cumsum(counts)
    return A.signed(A.mix(total[ends] - total[ends - counts] + counts.astype(np.uint64)))


def size_classes(largest: int, num: int, den: int) -> np.ndarray:
    """Upper bounds of size classes; a linked pair lies in one class or in two neighbours."""
    bounds, low = [0], 1
    while low <= largest:
        bounds.append(max(low, low * den // num))
        low = bounds[-1] + 1
    return np.array(bounds, np.int64)


def part_keys(values: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all parts of every set, and their number; sets with a link share a key.

    A set of class c is dealt for partners of its own class and for larger ones
    of class c + 1, each time into one part more than the set and its partner can
    differ in.
    """
    bounds = size_classes(int(counts.max(initial=1)) * den // num + 2, num, den)
    own = np.searchsorted(bounds, counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    deal = (A.mix(values + np.uint64(11)) >> np.uint64(20)).astype(np.int64)
    low = A.mix(values + np.uint64(23))
    keys, owners = [], []
    for step in (0, 1):
        kind = np.minimum(own + step, len(bounds) - 1)
        parts = np.where(counts > 0, 2 * bounds[kind] * (den - num) // (den + num) + 1, 0)
        parts[parts == 1] = 0  # such sets would have to be equal
        first = np.cumsum(parts) - parts
        use = parts[rows] > 0
        slot = first[rows[use]] + deal[use] % parts[rows[use]]
        total = int(parts.sum())
        lo = np.bincount(slot, weights=(low[use] & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
        hi = np.bincount(slot, weights=(low[use] >> np.uint64(32)).astype(np.float64), minlength=total)
        owner = np.repeat(np.arange(len(counts)), parts)
        number = np.arange(total) - first[owner]
        keys.append(A.mix(A.mix(lo.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * hi.astype(np.uint64)) + (kind[owner] * 2**24 + number).astype(np.uint64)))
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def jaccard_components(
    docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and ``print``, the hash of its text."""
    return _rooted(docs, num, den, width, id_column, text).drop("root")


def _rooted(
    docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The components, and ``root``, which tells them apart where ids are missing or repeated."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("print"), docs[text].alias("text"))

    def sizes(batches):
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                values, counts = shingle_sets(part.column("text"), width)
                columns = [part.column("doc_id"), part.column("print"), pa.array(counts), pa.array(set_ids(values, counts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n", "node"])

    def keys(batches):
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                values, counts = shingle_sets(part.column("text"), width)
                found, owner = part_keys(values, counts, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(found)), pa.array(set_ids(values, counts)[owner])], ["key", "node"])

    def tokens(batches):
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                values, counts = shingle_sets(part.column("text"), width)
                offsets = np.concatenate(([0], np.cumsum(counts) * 8)).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
                yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("node"), sets], ["cluster", "node", "content"])

    sized = materialize(rows.mapInArrow(sizes, "doc_id long, print long, n long, node long"), "sizes")
    near = components(link_by_key(rows.select("text").mapInArrow(keys, "key long, node long")))
    # One row stands for each node: its id alone may be missing or repeated, so its text's hash goes with it.
    leads = sized.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("lead"), F.min(F.struct("doc_id", "print")).alias("row"))
    leads = materialize(leads, "nodes")
    wanted = near.join(leads, "node").select(F.col("row.doc_id").alias("id"), F.col("row.print").alias("mark"), F.col("root").alias("cluster"), "node")
    chosen = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["print"] == wanted["mark"]))
    items = chosen.select("cluster", "node", "text").mapInArrow(tokens, "cluster long, node long, content binary")
    linked = verified_components(items, num, den)
    lead = leads.drop("row").join(linked, "node", "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    names = lead.groupBy("root").agg(F.min("lead").alias("component_id"))
    name = lead.join(names, "root").select("node", "root", "component_id")
    return sized.join(name.withColumn("some", F.lit(True)), "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("some"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "print", "root"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with the first row of each component, by doc_id (missing ones last), text hash and all columns.

    Documents without words belong to no component and all stay.
    """
    found = materialize(_rooted(docs, id_column=id_column, text=text, **options).where("n_shingles > 0"), "found")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    groups = found.groupBy("doc_id", "print", "root").agg(F.count(F.lit(1)).alias("n"))
    firsts = found.groupBy("root").agg(F.min(place).alias("first")).withColumnRenamed("root", "__root")
    placed = materialize(groups.join(firsts, F.col("root") == F.col("__root")).select("doc_id", "print", "n", (place == F.col("first")).alias("stays")), "placed")
    gone = placed.where("not stays").select("doc_id", F.col("print").alias("mark"))
    rows = keyed(docs, id_column, text)
    kept = rows.join(gone, same_text(rows, gone), "left_anti")
    return unkeyed(first_rows(kept, placed.where("stays and n > 1")))
