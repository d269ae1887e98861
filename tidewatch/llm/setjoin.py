"""Exact Jaccard links inside candidate clusters, by trees of token bitmaps.

A task gets one tile: all items of a cluster, or two blocks of a large one. Its
items become the leaves of a tree; every node keeps the OR of its items' token
bitmaps, the range of their set sizes, and the most tokens that share a bit with
another token of their set. Two nodes go on together only if the largest overlap
that bitmaps and sizes allow can still reach the threshold. Pairs of leaves that
are left are compared exactly, unless links found before already connect them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.arrays import expand, mix
from tidewatch.llm.frames import components
from tidewatch.session import materialize

FANOUT = 8
LEAF_ITEMS = 32  # sets of one leaf, compared with each other directly
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 16_000_000
STEPS = 7  # of set sizes in an octave, by which the leaves of a tree stand
CHUNK = 100_000


Sets = tuple[np.ndarray, np.ndarray]  # all tokens one set after the other, and the size of each


def hashes_of(content: pa.Array) -> Sets:
    """Token sets that are stored as bytes of sorted 64-bit hashes."""
    size = pc.binary_length(content).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = content.buffers()
    start = np.frombuffer(offsets, np.int32)[content.offset]
    return np.frombuffer(data, np.uint8)[start : start + int(size.sum())].view(np.uint64), size // 8


def verified_components(items: DataFrame, num: int, den: int, unpack: Callable[[pa.Array], Sets] = hashes_of) -> DataFrame:
    """node and root of items whose sets are linked, directly or over others.

    ``items`` has ``cluster``, ``node`` (long) and ``content`` (binary), which
    ``unpack`` turns into sorted distinct 64-bit hashes. Two items of one cluster are linked if their Jaccard
    similarity is at least num / den. Clusters with more items or bytes than one
    tile holds are dealt in blocks by the hash of their node, and every pair of
    blocks makes a tile of its own.
    """
    items = materialize(items.withColumn("length", F.length("content")), "items")
    size = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    large = size.where((F.col("n") > BLOCK_ITEMS) | (F.col("bytes") > BLOCK_BYTES)).select(
        "cluster", F.ceil(F.greatest(F.col("n") / BLOCK_ITEMS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    # Stored, so that the few large ones are sent to the items and not the items' contents to them.
    large = materialize(large, "large")
    dealt = (
        items.join(large, "cluster", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "node", "content")
    )
    edges = (
        dealt.repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "node")
        .mapInArrow(lambda batches: _tiles(batches, num, den, unpack), "a long, b long")
    )
    return components(edges)


def _tiles(batches: Iterator[pa.RecordBatch], num: int, den: int, unpack) -> Iterator[pa.RecordBatch]:
    """Whole tiles are taken together; rows of the one still open wait for the next batch."""
    open_ = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (rows if open_ is None else pa.concat_tables([open_, rows])).combine_chunks()
        keys = np.stack([rows[c].to_numpy() for c in ("cluster", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield from _edges(_links(rows.slice(0, last), num, den, unpack))
        open_ = rows.slice(last)
    if open_ is not None:
        yield from _edges(_links(open_, num, den, unpack))


def _edges(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _links(rows: pa.Table, num: int, den: int, unpack) -> np.ndarray:
    """Linking pairs of nodes in each of the tiles that the rows make up."""
    cluster, i, j, k, node = (rows[c].to_numpy() for c in ("cluster", "i", "j", "k", "node"))
    new_tile = np.concatenate(([True], (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    tile = np.cumsum(new_tile) - 1
    # Rows of one node in one tile have one set; a node that is alone has no partner.
    keep = new_tile | np.concatenate(([True], node[1:] != node[:-1]))
    keep &= np.bincount(tile[keep])[tile] > 1
    if not keep.any():
        return np.zeros((0, 2), np.int64)
    content = rows["content"].combine_chunks()
    content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
    flat, sizes = unpack(content.filter(pa.array(keep)))
    node, tile, side, crossing = node[keep], tile[keep], k[keep], (i != j)[keep]
    first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    count = np.diff(np.append(first, len(tile)))
    begin = np.cumsum(sizes) - sizes
    out = [_pairs(flat, sizes, begin, first[count == 2], side, crossing, num, den)]
    for at, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        own = slice(at, at + n)
        tokens = [flat[x : x + y] for x, y in zip(begin[own].tolist(), sizes[own].tolist(), strict=True)]
        out.append(forest(tokens, num, den, side[own] if crossing[at] else None) + at)
    return node[np.concatenate(out)]


def _pairs(flat, sizes, begin, first, side, crossing, num: int, den: int) -> np.ndarray:
    """The linked ones of many tiles of two sets each, all at once."""
    first = first[~crossing[first] | (side[first] != side[first + 1])]
    if not len(first):
        return np.zeros((0, 2), np.int64)
    total = sizes[first] + sizes[first + 1]
    values = flat[expand(begin[first], total)]  # the two sets of a tile are neighbours
    # Tile and token in one number: the tile's bits take the place of the token's lowest.
    bits = np.uint64(max(1, len(first).bit_length()))
    owner = np.repeat(np.arange(len(first), dtype=np.uint64), total)
    marked = np.sort(owner << (np.uint64(64) - bits) | values >> bits)
    twice = marked[1:][marked[1:] == marked[:-1]]
    both = np.bincount((twice >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(first))
    hit = first[((num + den) * both >= num * total) & (both > 0)]
    return np.stack([hit, hit + 1], axis=1)


def forest(tokens: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of positions that connect all linked sets, as few as needed.

    With ``side`` only sets of different sides are compared.
    """
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if len(tokens) <= LEAF_ITEMS:
        left, held = _all_pairs(sizes, num, den), sizes
    else:
        # Only the sets that the trees leave over get numbers for their tokens.
        left = list(_survivors(tokens, sizes, num, den, side))
        if not left:
            return np.zeros((0, 2), np.int64)
        some = np.zeros(len(tokens), bool)
        for a, others in left:
            some[a] = some[others] = True
        held = np.where(some, sizes, 0)
        tokens = [tokens[k] for k in np.flatnonzero(some).tolist()]
    universe, codes = np.unique(np.concatenate(tokens), return_inverse=True)
    firsts = np.cumsum(held) - held
    label = np.arange(len(sizes))
    mark = np.zeros(len(universe), bool)
    out = []
    for a, others in left:
        if side is not None:
            others = others[side[others] != side[a]]
        others = others[label[others] != label[a]]
        if not len(others):
            continue
        own = codes[firsts[a] : firsts[a] + sizes[a]]
        mark[own] = True
        # A few at a time: links found on the way make later comparisons needless.
        for part in np.array_split(others, -(-len(others) // 64)):
            part = part[label[part] != label[a]]
            if not len(part):
                continue
            ends = np.cumsum(sizes[part])
            hits = np.concatenate(([0], np.cumsum(mark[codes[expand(firsts[part], sizes[part])]])))
            both = hits[ends] - hits[ends - sizes[part]]
            for b in part[((num + den) * both >= num * (sizes[a] + sizes[part])) & (both > 0)].tolist():
                if label[b] != label[a]:
                    out.append((a, b))
                    label[label == label[b]] = label[a]
        mark[own] = False
    return np.array(out, np.int64).reshape(-1, 2)


def _all_pairs(sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """What one leaf holds is compared without a tree, by size alone."""
    for a in range(len(sizes) - 1):
        rest = sizes[a + 1 :]
        yield a, a + 1 + np.flatnonzero((num * rest <= den * sizes[a]) & (num * sizes[a] <= den * rest))


def _survivors(
    tokens: list[np.ndarray], sizes: np.ndarray, num: int, den: int, side: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """For each item the others that bitmaps, sizes and sides do not rule out, by dual traversal.

    Leaves stand by side and by size in steps of a tenth, so that nodes span few sizes.
    """
    n = len(tokens)
    bits = int(np.clip(1 << int(2 * np.median(sizes)).bit_length(), 256, 8192))
    flags = np.zeros((n, bits), bool)
    mixed = mix(np.concatenate(tokens))
    flags[np.repeat(np.arange(n), sizes), (mixed % np.uint64(bits)).astype(np.int64)] = True
    words = np.packbits(flags, axis=1).view(np.uint64)
    del flags
    least = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        least[full] = np.minimum.reduceat(mixed, (np.cumsum(sizes) - sizes)[full])
    side = np.zeros(n, np.int64) if side is None else np.where(side == side[0], 1, 2)  # 0 meets all
    order = np.lexsort((least, (STEPS * np.log2(np.maximum(sizes, 1))).astype(int), side))
    words, ordered, side = words[order], sizes[order], side[order]
    levels = [(words, ordered, ordered, ordered - np.bitwise_count(words).sum(axis=1, dtype=np.int64), side)]
    while len(levels[-1][0]) > FANOUT:
        w, low, high, slack, side = levels[-1]
        cut = np.arange(0, len(w), FANOUT)
        both = np.where(np.minimum.reduceat(side, cut) == np.maximum.reduceat(side, cut), side[cut], 0)
        levels.append((np.bitwise_or.reduceat(w, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), both))
    top = len(levels) - 1
    roots = len(levels[top][0])
    x, y = np.triu_indices(roots)
    # Depth first over the pairs of root nodes keeps the frontier small.
    stack = [(top, x, y)]
    partners: dict[int, list[np.ndarray]] = {}
    while stack:
        level, x, y = stack.pop()
        if len(x) > CHUNK:
            half = len(x) // 2
            stack += [(level, x[:half], y[:half]), (level, x[half:], y[half:])]
            continue
        w, low, high, slack, side = levels[level]
        fits = (num * low[y] <= den * high[x]) & (num * low[x] <= den * high[y]) & ((side[x] != side[y]) | (side[x] == 0))
        x, y = x[fits], y[fits]
        common = np.bitwise_count(w[x] & w[y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(common + slack[x], common + slack[y]), np.minimum(high[x], high[y]))
        reach = (num + den) * most >= num * (low[x] + low[y])
        x, y = x[reach], y[reach]
        if level == 0:
            apart = x < y
            for a, b in _grouped(x[apart], y[apart]):
                partners.setdefault(a, []).append(b)
            continue
        below = len(levels[level - 1][0])
        kids = np.arange(FANOUT)
        cx = np.repeat(x[:, None] * FANOUT + kids, FANOUT, axis=1).ravel()
        cy = np.tile(y[:, None] * FANOUT + kids, (1, FANOUT)).ravel()
        keep = (cx < below) & (cy < below) & (cx <= cy)
        stack.append((level - 1, cx[keep], cy[keep]))
    for a in sorted(partners):
        yield int(order[a]), order[np.concatenate(partners.pop(a))]


def _grouped(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(x):
        return
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(np.int32)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    yield from zip(x[np.concatenate(([0], cut))].tolist(), np.split(y, cut), strict=True)
