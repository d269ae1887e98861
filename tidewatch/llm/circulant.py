"""Operator 13, near-duplicate documents by circulant MinHash.

A document's set are its distinct five-word shingles (with fewer words the whole
sequence is one). Two permutations make the whole signature: the first, sigma,
gives every shingle its place on a circle of 2^32 places; the second, pi, is turned
by one place for each further coordinate, so that coordinate k is the least
pi(sigma(x) + k) over the set. Twenty-four bands of six coordinates follow. A pair
at the threshold of 0.85 shares no band with a probability of 0.377 missing 24
times, 0.00001; from 0.9 on it is below 10^-7.

Documents with equal sets are one node at once. Every node of a band's bucket is
tied to the bucket's least node (one aggregate and one join, no pairs), union-find
makes clusters of the ties, and inside a cluster the links are confirmed on the
full sets (``setjoin``). A second union-find over confirmed links alone gives the
components; of each the smallest doc_id is kept.

A null text, or one without words, has an empty set, is linked with nothing and is
kept. Rows that repeat a doc_id are judged by their own text. A null doc_id is the
id of a component only if no member has another; such rows are kept then. Rows
that repeat an id and text have equal results. Texts may have any length. Sets are
told apart by 64-bit hashes of their shingles. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import arrays as A
from tidewatch.llm.frames import components
from tidewatch.llm.ngram_join import set_ids, shingle_sets
from tidewatch.llm.setjoin import verified_components
from tidewatch.session import materialize

NUM, DEN, WIDTH = 85, 100, 5
BANDS, DEPTH = 24, 6
_TILE = 1 << 15  # shingles taken through all coordinates at once; they stay in the processor's cache


def sigma(shingles: np.ndarray) -> np.ndarray:
    """The place of every shingle on the circle."""
    return (A.mix(shingles + np.uint64(0x51ED2701)) >> np.uint64(32)).astype(np.uint32)


def pi(places: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the circle's places."""
    np.right_shift(places, 16, out=spare)
    np.bitwise_xor(places, spare, out=out)
    out *= np.uint32(0x85EBCA6B)
    np.right_shift(out, 13, out=spare)
    out ^= spare
    out *= np.uint32(0xC2B2AE35)
    return out


def signatures(values: np.ndarray, counts: np.ndarray, size: int = BANDS * DEPTH) -> np.ndarray:
    """Coordinates by sets. No set is empty."""
    places = sigma(values)
    ends = np.cumsum(counts)
    out = np.empty((size, len(counts)), np.uint32)
    done = 0
    while done < len(counts):
        begin = int(ends[done] - counts[done])
        stop = max(done + 1, int(np.searchsorted(ends, begin + _TILE, side="right")))
        part = places[begin : ends[stop - 1]]
        firsts = (ends[done:stop] - counts[done:stop] - begin).astype(np.int64)
        turned, hashed, spare = part.copy(), np.empty_like(part), np.empty_like(part)
        for k in range(size):
            turned += np.uint32(1)  # the circle turns by one place
            out[k, done:stop] = np.minimum.reduceat(pi(turned, hashed, spare), firsts)
        done = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Sets by bands."""
    keys = np.zeros((signature.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        for k in range(DEPTH):
            keys[:, b] = A.mix(keys[:, b] + signature[b * DEPTH + k] + np.uint64(b + 1))
    return keys


def _rows(num: int, den: int, width: int):
    def work(batches):
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                values, counts = shingle_sets(part.column("text"), width)
                # A smaller set can only be linked with an equal one.
                able = counts * (den - num) >= num
                number = np.where(able, BANDS, 0)
                keys = np.zeros((0, BANDS), np.uint64)
                if able.any():
                    keys = band_keys(signatures(values[np.repeat(able, counts)], counts[able]))
                bands = A.list_column(A.signed(keys.ravel()), number, pa.int64())
                columns = [part.column("doc_id"), part.column("print"), pa.array(counts), pa.array(set_ids(values, counts)), bands]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n", "node", "bands"])

    return work


def _contents(width: int):
    def work(batches):
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                values, counts = shingle_sets(part.column("text"), width)
                offsets = np.concatenate(([0], np.cumsum(counts) * 8)).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
                yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("node"), sets], ["cluster", "node", "content"])

    return work


def ties(nodes: DataFrame) -> DataFrame:
    """a, b: every node of a bucket and the bucket's least node. ``nodes`` has ``node`` and ``bands``."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    return keyed.join(least, "key").where("a <> node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("print"), docs[text].alias("text"))
    sized = materialize(rows.mapInArrow(_rows(num, den, width), "doc_id long, print long, n long, node long, bands array<long>"), "signatures")
    # Equal sets meet before anything else; one row of each stands for it.
    leads = sized.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("lead"), F.min(F.struct("doc_id", "print")).alias("row"), F.first("bands").alias("bands"))
    leads = materialize(leads, "nodes")
    near = components(ties(leads.select("node", "bands")))
    wanted = near.join(leads, "node").select(F.col("row.doc_id").alias("id"), F.col("row.print").alias("mark"), F.col("root").alias("cluster"), "node")
    chosen = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["print"] == wanted["mark"]))
    items = chosen.select("cluster", "node", "text").mapInArrow(_contents(width), "cluster long, node long, content binary")
    linked = verified_components(items, num, den)
    rooted = leads.select("node", "lead").join(linked, "node", "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lead").alias("component"))
    named = rooted.join(least, "root").select("node", "component", F.lit(True).alias("some"))
    component = F.when(F.col("some"), F.col("component")).otherwise(F.col("doc_id"))
    out = sized.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
