"""Operator 2, token ids in binary shards with a minimal perfect hash index.

``write_tokens`` encodes all texts and writes these tables below one folder:

* ``payload``: the raw ids as little-endian unsigned integers of two bytes (four
  if the vocabulary needs them), in blocks of whole documents in ascending
  ``doc_id`` order, nulls first. A shard is one range of ``doc_id``; a block
  row holds ``shard, block, payload``. The table is bucketed by shard, so reading
  it back by shard needs no exchange.
* ``index``: for every group of keys one row with a minimal perfect hash: a
  pilot per small bucket sends each key to its own slot, and slot arrays hold a
  fingerprint, shard, block, offset, length and start of the document there.
* ``manifest``: one row with the version, the width of an id, and the numbers of
  buckets and groups. It is written last, so a folder that has it is whole, and
  ``open_tokens`` needs nothing else to read the files in another session.

A lookup hashes the key to its group, reads one pilot, goes to one slot, and
compares the fingerprint. Constant work per key; unknown keys are told apart by
64 fingerprint bits. Rows that repeat a doc_id are all written, next to each
other; the slot has the first, and ``more`` lists the others by their key.

Null doc_id counts as a key of its own, null text as empty (it has the end id
only). Texts may have any length; a block holds at least one document whole.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from tidewatch.llm.arrays import expand, mix, pieces_of
from tidewatch.llm.bpe import vocabulary_path
from tidewatch.llm.pieces import Encoder, crc32_rows
from tidewatch.session import new_path

END_ID = 2
SHARD_CHARS = 16_000_000  # text per shard
BLOCK_IDS = 100_000  # ids per block, unless one document has more
WORDS = 2_000  # words per call of the library
GROUP_KEYS = 20_000  # keys per perfect hash
NULL_KEY = -(2**63)
BLOCKS = "shard int, block int, payload binary, keys array<long>, offsets array<long>, sizes array<long>"
PLACES = {"shard": pa.int32(), "block": pa.int32(), "offset": pa.int64(), "n_tokens": pa.int64(), "start": pa.int64(), "rows": pa.int64()}
VERSION = 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    library = Tokenizer.from_file(path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    library.no_truncation()
    library.no_padding()

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), WORDS):  # the library's results take far more memory than the ids
            rows = [e.ids for e in library.encode_batch_fast([w.decode() for w in words[k : k + WORDS]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, rows), np.int64, len(rows)))
            ids.append(np.fromiter((x for r in rows for x in r), np.int64, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    special = {t.content: k for k, t in library.get_added_tokens_decoder().items()}
    return Encoder(encode, special)


def _width(path: str) -> type:
    return np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 2**16 else np.uint32


def write_tokens(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Encode ``docs`` and write payload and index below ``folder``."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    width = _width(path)

    def encode(batches):
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), _encoder(path)
        block, held_ids, held_keys, held_sizes, held = 0, [], [], [], 0

        def flush():
            ids, sizes = np.concatenate(held_ids), np.concatenate(held_sizes)
            payload = ids.astype(np.dtype(width).newbyteorder("<")).tobytes()
            offsets = np.cumsum(sizes) - sizes
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([payload], pa.binary()),
                    pa.array([pa.concat_arrays(held_keys).to_pylist()], pa.list_(pa.int64())),
                    pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())),
                ],
                ["shard", "block", "payload", "keys", "offsets", "sizes"],
            )

        for batch in batches:
            for part in pieces_of(batch, "text"):
                ids, counts = encoder.ids(part.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                sizes = counts + 1
                ends = np.cumsum(sizes)
                done = 0
                while done < len(sizes):
                    base = ends[done - 1] if done else 0
                    stop = max(done + 1, int(np.searchsorted(ends, base + BLOCK_IDS - held, side="right")))
                    held_ids.append(ids[base : ends[stop - 1]])
                    held_sizes.append(sizes[done:stop])
                    held_keys.append(part.column("doc_id")[done:stop])
                    held += int(ends[stop - 1] - base)
                    done = stop
                    if held >= BLOCK_IDS or done < len(sizes):
                        yield flush()
                        block, held_ids, held_keys, held_sizes, held = block + 1, [], [], [], 0
        if held:
            yield flush()

    # The order within a doc_id is that of the text, so that repeated runs agree.
    blocks = (
        rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
        .mapInArrow(encode, BLOCKS)
    )
    name, buckets = _new_name(), 2 * shards
    (
        blocks.write.option("path", f"{folder}/payload").option("compression", "zstd")
        .bucketBy(buckets, "shard").sortBy("block").format("parquet").saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # the files stay
    files = TokenFiles(spark, folder, width, buckets)
    files.build_index()
    facts = {"version": VERSION, "id_bytes": np.dtype(width).itemsize, "buckets": buckets, "groups": files.groups}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()]).write.json(f"{folder}/manifest")
    return files


def open_tokens(spark: SparkSession, folder: str) -> TokenFiles:
    """The reader of files that another session may have written; a folder without a manifest is an error."""
    facts = spark.read.schema("version int, id_bytes int, buckets int, groups int").json(f"{folder}/manifest").first()
    if facts is None or facts["version"] != VERSION:
        raise ValueError(f"{folder} holds no token files of version {VERSION}")
    return TokenFiles(spark, folder, {2: np.uint16, 4: np.uint32}[facts["id_bytes"]], facts["buckets"], facts["groups"])


def _new_name() -> str:
    return "tokens_" + uuid.uuid4().hex


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The payload with its buckets known; the catalogue has its name only while it is looked up."""
    name, quoted = _new_name(), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({BLOCKS}) USING parquet CLUSTERED BY (shard) SORTED BY (block) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return blocks


def hash_key(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def slots(hashes: np.ndarray, pilots: np.ndarray, size: int) -> np.ndarray:
    """The slot of each key hash: its bucket's pilot re-mixes the hash."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(len(pilots))
    return (mix(hashes + pilots[bucket.astype(np.int64)].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) % np.uint64(size)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> np.ndarray:
    """Pilots that send distinct hashes to distinct slots 0..n-1, largest buckets placed first."""
    n = len(hashes)
    count = max(1, n // 3)
    bucket = ((hashes >> np.uint64(40)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=count)
    first = np.cumsum(size) - size
    pilots, taken = np.zeros(count, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable").tolist():
        if size[b] == 0:
            break
        own = hashes[order[first[b] : first[b] + size[b]]]
        base = 0
        while True:
            # Many pilots are tried at once; the first that fits is taken.
            tries = np.arange(base, base + 64, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
            spots = (mix((own[None, :] + tries[:, None]).ravel()) % np.uint64(n)).astype(np.int64).reshape(64, -1)
            free = ~taken[spots].any(axis=1)
            if len(own) > 1:
                inside = np.sort(spots, axis=1)
                free &= (inside[:, 1:] != inside[:, :-1]).all(axis=1)
            hit = np.flatnonzero(free)
            if len(hit):
                pilots[b] = base + hit[0]
                taken[spots[hit[0]]] = True
                break
            base += 64
    return pilots


class TokenFiles:
    """Reader of the files that ``write_tokens`` writes; see ``open_tokens``."""

    def __init__(self, spark: SparkSession, folder: str, width: type, buckets: int, groups: int = 1):
        self.spark, self.folder, self.width, self.groups = spark, folder, width, groups
        self._blocks = _bucketed(spark, f"{folder}/payload", buckets)

    def blocks(self) -> DataFrame:
        return self._blocks

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def more(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/more")

    def _places(self) -> DataFrame:
        """One row per document with its shard, block, offset, length and start over all shards."""
        each = self.blocks().select("shard", "block", F.arrays_zip("keys", "offsets", "sizes").alias("d"))
        sums = self.blocks().select("shard", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
        # Shards number one for every few million ids, blocks of a shard a few hundred.
        whole = sums.groupBy("shard").agg(F.sum("n").alias("n"))
        before = whole.select(
            "shard", F.expr("coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0)").alias("shard_start")
        )
        inner = sums.select(
            "shard", "block",
            F.expr("coalesce(sum(n) over (partition by shard order by block rows between unbounded preceding and 1 preceding), 0)").alias("block_start"),
        )
        starts = inner.join(before, "shard").select("shard", "block", (F.col("block_start") + F.col("shard_start")).alias("base"))
        return each.join(starts, ["shard", "block"]).select(
            "shard", "block", "base", F.explode("d").alias("d")
        ).select(
            F.coalesce("d.keys", F.lit(NULL_KEY)).alias("key"), "shard", "block",
            F.col("d.offsets").alias("offset"), F.col("d.sizes").alias("n_tokens"), (F.col("base") + F.col("d.offsets")).alias("start"),
        )

    def build_index(self) -> None:
        """Write the perfect hashes, one row per group of keys, and the places of repeated keys."""
        places = self._places()
        first = places.groupBy("key").agg(F.min(F.struct("start", "shard", "block", "offset", "n_tokens")).alias("p"), F.count(F.lit(1)).alias("rows"))
        one = first.select("key", "p.*", "rows")
        groups = max(1, -(-one.agg(F.count(F.lit(1))).first()[0] // GROUP_KEYS))
        self.groups = groups

        def build(keys):
            hashes = hash_key(keys["key"].to_numpy())
            pilots = perfect_hash(hashes)
            at = np.empty(len(hashes), np.int64)
            at[slots(hashes, pilots, len(hashes))] = np.arange(len(hashes))
            row = {"grp": int(keys["grp"].iloc[0]), "pilots": pilots.tolist(), "prints": mix(hashes).view(np.int64)[at].tolist()}
            row |= {c: keys[c].to_numpy()[at].tolist() for c in ("shard", "block", "offset", "n_tokens", "start", "rows")}
            import pandas as pd

            return pd.DataFrame([row])

        kinds = "grp int, pilots array<long>, prints array<long>, shard array<int>, block array<int>, offset array<long>, n_tokens array<long>, start array<long>, rows array<long>"
        one.withColumn("grp", _group(F.col("key"), groups)).groupBy("grp").applyInPandas(build, kinds).write.parquet(f"{self.folder}/index")
        again = first.where("rows > 1").select("key", F.col("p.start").alias("head"))
        places.join(again, "key").where("start > head").drop("head").write.parquet(f"{self.folder}/more")

    def lookup(self, keys: DataFrame, column: str = "doc_id") -> DataFrame:
        """Places of the given keys by the perfect hash; keys that are not there give no row.

        A key that stands for several documents gives a row for each of them.
        """
        asked = keys.select(F.coalesce(keys[column].cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
        grouped = asked.withColumn("grp", _group(F.col("key"), self.groups)).groupBy("grp").agg(F.collect_list("key").alias("keys"))
        joined = grouped.join(self.index(), "grp")

        def find(batches):
            # The lists are read as buffers: one pilot and one slot are touched for a key.
            for batch in batches:
                lists = dict(zip(batch.schema.names, batch.columns, strict=True))
                for k in range(batch.num_rows):
                    at_row = lambda c: lists[c][k].values.to_numpy()  # noqa: B023, E731
                    keys, prints = at_row("keys"), at_row("prints")
                    hashes = hash_key(keys)
                    at = slots(hashes, at_row("pilots"), len(prints))
                    known = prints[at] == mix(hashes).view(np.int64)
                    columns = [pa.array(keys[known])] + [pa.array(at_row(c)[at[known]], kind) for c, kind in PLACES.items()]
                    yield pa.RecordBatch.from_arrays(columns, ["key", *PLACES])

        kinds = "key long, shard int, block int, offset long, n_tokens long, start long"
        found = joined.mapInArrow(find, kinds + ", rows long")
        others = self.more().join(found.where("rows > 1").select("key").distinct(), "key")
        names = ["key", "shard", "block", "offset", "n_tokens", "start"]
        return found.select(*names).unionByName(others.select(*names))

    def _read(self, places: DataFrame, schema: str, make) -> DataFrame:
        """Apply ``make(keys, starts, sizes, ids)`` to the documents at the given places, block by block."""
        wanted = places.groupBy("shard", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "n_tokens", "start", "key"))).alias("docs"))
        joined = self.blocks().select("shard", "block", "payload").join(wanted.hint("shuffle_hash"), ["shard", "block"])
        kind = np.dtype(self.width).newbyteorder("<")

        def read(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    docs = batch.column("docs")[k].values
                    offset, size, start, key = (docs.field(c).to_numpy(zero_copy_only=False) for c in ("offset", "n_tokens", "start", "key"))
                    ids = np.frombuffer(batch.column("payload")[k].as_buffer(), kind)
                    yield make(key, start, size, ids[expand(offset, size)])

        return joined.select("payload", "docs").mapInArrow(read, schema)

    def digest(self, keys: DataFrame, column: str = "doc_id") -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of the documents with the given keys, read from the files."""

        def make(key, start, size, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array(key, mask=key == NULL_KEY), pa.array(start), pa.array(size), pa.array(crc32_rows(ids.astype("<u4"), size))],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

        return self._read(self.lookup(keys, column), "doc_id long, start long, n_tokens long, ids_crc32 long", make)

    def fetch(self, keys: DataFrame, column: str = "doc_id") -> DataFrame:
        """doc_id, start and ids of the documents with the given keys."""

        def make(key, start, size, ids):
            offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(key, mask=key == NULL_KEY), pa.array(start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                ["doc_id", "start", "ids"],
            )

        return self._read(self.lookup(keys, column), "doc_id long, start long, ids array<int>", make)


def _group(key, groups: int):
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write all documents, then read every one back through the index."""
    files = write_tokens(docs, new_path(docs.sparkSession, "tokens"))
    return files.digest(docs.select("doc_id"))
