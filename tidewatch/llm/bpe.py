"""Operator 9, BPE encoding and decoding: speculate, verify, repair.

Each distinct piece is first cut greedily into its longest vocabulary entries.
That guess is the BPE result exactly if every entry is reached by its own merges
and no merge across the seam of any two neighbours could have come before the
merges that built them; both are checked for all seams of a batch at once. Only
pieces with a failing check are merged step by step. Decoding gathers the bytes
of the ids and reads them as UTF-8.

Null texts count as empty and give no ids; repeated rows give repeated results;
a special token's string inside a text is that token, as in the library. Texts
may have any length. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.arrays import expand, pieces_of
from tidewatch.llm.pieces import Encoder, sha256_rows

VOCABULARY = "byte_bpe_50k.json"
NEVER = np.int64(1) << 40
# Longer words are merged one by one with a queue; the results are the same.
LONG = 64


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and what the seam check needs to know about each token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs = byte_signs()
        names = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max([*names.values(), *self.special.values()])
        self.bytes = [b""] * size
        for name, k in names.items():
            self.bytes[k] = bytes(signs[c] for c in name)
        for name, k in self.special.items():
            self.bytes[k] = name.encode()
        self.id = {self.bytes[k]: k for k in names.values()}
        self.rank: dict[tuple[int, int], int] = {}
        # For each token its two parts and the rank of the merge that makes it.
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        self.made: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(file["model"]["merges"]):
            a, b = (names[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            c = names["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")]
            self.rank[a, b], self.made[a, b] = k, c
            if self.born[c] < 0:
                self.left[c], self.right[c], self.born[c] = a, b, k
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, np.append(keys[order], NEVER)
        self.ranks = np.append(np.array(list(self.rank.values()), np.int64)[order], NEVER)
        self.makes = np.append(np.array(list(self.made.values()), np.int64)[order], 0)
        self.of_byte = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        self._plant()
        self.sound = self._sound()
        sizes = np.fromiter(map(len, self.bytes), np.int64, size)
        self.width, self.at = sizes, np.cumsum(sizes) - sizes
        self.all = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.makes[np.searchsorted(self.keys, a * self.size + b)]

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def seams_hold(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether each pair stays two tokens when its bytes are merged together.

        Both sides are taken apart again, latest merge first. A pair (l, r) met on
        the way would merge over the seam if its rank comes before the merge that
        used up l, or not after the one that used up r: of equal ranks the one
        further left comes first. ``own`` leaves out the pair itself.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        l, r = a.astype(np.int64), b.astype(np.int64)
        l_next = np.full(len(a), NEVER)
        r_next = np.full(len(a), NEVER)
        first = own
        while len(live):
            if not first:
                q = self._merge_rank(l, r)
                bad = (q < NEVER) & (q < l_next) & (q <= r_next)
                ok[live[bad]] = False
                go = ~bad
            else:
                go, first = np.ones(len(live), bool), False
            go &= (self.born[l] >= 0) | (self.born[r] >= 0)
            live, l, r, l_next, r_next = live[go], l[go], r[go], l_next[go], r_next[go]
            undo_r = self.born[r] >= self.born[l]
            r_next = np.where(undo_r, self.born[r], r_next)
            l_next = np.where(undo_r, l_next, self.born[l])
            l, r = np.where(undo_r, l, self.right[l]), np.where(undo_r, self.left[r], r)
        return ok

    def _sound(self) -> np.ndarray:
        """Tokens that their own bytes merge to: both parts are, and nothing comes between."""
        made = np.flatnonzero(self.born >= 0)
        sound = self.born < 0
        fits = self.seams_hold(self.left[made], self.right[made], own=True)
        for k, good in sorted(zip(made.tolist(), fits.tolist(), strict=True), key=lambda x: self.born[x[0]]):
            sound[k] = good and sound[self.left[k]] and sound[self.right[k]]
        return sound

    def _plant(self) -> None:
        """A tree of all token prefixes as one sorted table of (node, byte) -> node."""
        nodes: dict[bytes, int] = {b"": 0}
        for word in self.id:
            for k in range(1, len(word) + 1):
                nodes.setdefault(word[:k], len(nodes))
        keys = np.fromiter((nodes[w[:-1]] << 8 | w[-1] for w in nodes if w), np.int64, len(nodes) - 1)
        order = np.argsort(keys)
        self.edge = np.append(keys[order], NEVER)
        self.child = np.append(np.arange(1, len(nodes))[order], 0)
        self.token = np.full(len(nodes), -1, np.int64)
        for word, k in self.id.items():
            self.token[nodes[word]] = k

    def longest_match(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy cuts of all words side by side, one byte of each per step: tokens, and the word of each."""
        word = np.arange(len(begin))
        at, stop = begin.astype(np.int64), end.astype(np.int64)
        node = np.zeros(len(word), np.int64)
        best = np.full(len(word), -1, np.int64)
        after = at.copy()
        tokens, owners = [], []
        while len(word):
            key = node << 8 | data[at]
            found = np.searchsorted(self.edge, key)
            hit = self.edge[found] == key
            node = np.where(hit, self.child[found], 0)
            at = at + hit
            named = np.where(hit, self.token[node], -1)
            best = np.where(named >= 0, named, best)
            after = np.where(named >= 0, at, after)
            done = ~hit | (at == stop)
            if done.any():
                tokens.append(best[done])
                owners.append(word[done])
                at = np.where(done, after, at)
                node[done] = 0
                live = at < stop
                word, at, stop, node, best, after = (x[live] for x in (word, at, stop, node, best, after))
        flat, owner = np.concatenate(tokens or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def merge_all(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain BPE of many words side by side: in each step every word makes its lowest, leftmost merge."""
        sizes = end - begin
        tokens = self.of_byte[data[expand(begin, sizes)]]
        word = np.repeat(np.arange(len(begin)), sizes)
        rank = np.full(len(tokens), NEVER)
        if len(tokens) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self._merge_rank(tokens[:-1], tokens[1:]), NEVER)
        out, owners = [], []
        while len(tokens):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(word)))
            each = np.repeat(low, count)
            ready = each == NEVER
            out.append(tokens[ready])
            owners.append(word[ready])
            tokens, word, rank, each = tokens[~ready], word[~ready], rank[~ready], each[~ready]
            if not len(tokens):
                break
            spot = np.flatnonzero(rank == each)
            spot = spot[np.concatenate(([True], word[spot[1:]] != word[spot[:-1]]))]
            tokens[spot] = self._made(tokens[spot], tokens[spot + 1])
            keep = np.ones(len(tokens), bool)
            keep[spot + 1] = False
            spot -= np.arange(len(spot))
            tokens, word, rank = tokens[keep], word[keep], rank[keep]
            for near in (spot - 1, spot):
                near = near[near >= 0]
                inside = near + 1 < len(tokens)
                near, edge = near[inside], near[~inside]
                rank[edge] = NEVER
                same = word[near] == word[near + 1]
                rank[near] = np.where(same, self._merge_rank(tokens[near], tokens[near + 1]), NEVER)
        flat, owner = np.concatenate(out or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def merge_one(self, word: bytes) -> list[int]:
        """Plain BPE of one long word with a queue of possible merges, lowest rank and leftmost first."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        queue = [(r, k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            j = after[k]
            if parts[k] is None or j < 0 or self.rank.get((parts[k], parts[j])) != r:
                continue
            parts[k], parts[j] = self.made[parts[k], parts[j]], None
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (q := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(queue, (q, left))
        return [p for p in parts if p is not None]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number for each: guess, check all seams at once, merge what fails."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(sizes)
        flat, word = self.longest_match(data, end - sizes, end)
        wrong = np.zeros(len(words), bool)
        wrong[word[~self.sound[flat]]] = True
        seam = np.flatnonzero(word[:-1] == word[1:])
        pairs, back = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
        hold = self.seams_hold(pairs // self.size, pairs % self.size)
        wrong[word[seam[~hold[back]]]] = True
        keep = ~wrong[word]
        tokens, owners = [flat[keep]], [word[keep]]
        short = np.flatnonzero(wrong & (sizes <= LONG))
        fixed, owner = self.merge_all(data, (end - sizes)[short], end[short])
        tokens.append(fixed)
        owners.append(short[owner])
        for k in np.flatnonzero(wrong & (sizes > LONG)).tolist():
            tokens.append(np.array(self.merge_one(words[k]), np.int64))
            owners.append(np.full(len(tokens[-1]), k))
        flat, word = np.concatenate(tokens), np.concatenate(owners)
        return flat[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids and the number of bytes of each row."""
        width = self.width[ids]
        data = self.all[expand(self.at[ids], width)]
        ends = np.concatenate(([0], np.cumsum(width)))
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        return data, np.diff(bounds)


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Vocabulary, Encoder]:
    vocabulary = Vocabulary(path)
    return vocabulary, Encoder(vocabulary.encode, vocabulary.special)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; with ``ids`` also the ids and the decoded text."""
    path = path or vocabulary_path()
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if ids else ""

    def work(batches):
        vocabulary, encoder = _loaded(path)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                tokens, counts = encoder.ids(part.column("text"))
                data, sizes = vocabulary.decode(tokens, counts)
                # Every id sequence of a text decodes to whole characters; others get the replacement sign.
                raw = data.tobytes()
                ends = np.cumsum(sizes).tolist()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ids else []
                columns = [
                    part.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(sha256_rows(tokens, counts), pa.string()),
                    pa.array(sha256_rows(data, sizes), pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32))), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(work, schema)
