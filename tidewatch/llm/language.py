"""Operator 7, language identification as inference of a language mixture.

Every language is a distribution over hashed character trigrams, counted over all
labelled documents outside the held-out fold. A text is taken as a mixture: for a
set of languages, expectation-maximisation gives the proportions under which its
trigrams are likeliest. Sets grow from the likeliest single language by the next
in proportion for as long as the likelihood, less a penalty per language, rises.
The prediction is the largest proportion of the chosen set, ties to the name that
comes first, and the score is that proportion.

Text that is null or has no letter is ``und`` with score 0, as is everything if
nothing is learned. A null lang teaches nothing. There may be any number of
languages: the model has one number for each bucket that a language uses, so it
grows with the labels and not with the documents. A null doc_id counts as an empty
text in the fold. Repeated rows count again. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm import arrays as A
from tidewatch.llm.pieces import LETTER, _classes

BUCKETS = 1 << 16
SMOOTHING = 0.5
FOLDS = 5
ROUNDS = 12
PENALTY = 2.0  # times half the log of the number of trigrams, per language after the first
DENSE_LANGUAGES = 128  # up to here the model is one table, beyond it holds only the counts that are not 0
MOST_HELD = 2_000_000  # counts that a task holds before it sums them
UNKNOWN = "und"
LEAST_SHARE = 0.5


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case code points of letters, 0 for all else."""
    table = np.zeros(0x110000, np.uint64)
    for c in np.flatnonzero(_classes() == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams around a letter, their number per row, and rows with a letter."""
    data, starts = A.text_bytes(column)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sign = np.zeros(len(chars) + 2, np.uint64)
    sign[1:-1] = _folded()[chars]
    bounds = np.searchsorted(lead, starts)
    middle = np.flatnonzero(sign[1:-1])
    before, after = sign[middle].copy(), sign[middle + 2].copy()
    first = np.zeros(len(chars) + 1, bool)
    first[bounds] = True
    before[first[middle]] = 0
    after[first[middle + 1]] = 0
    code = A.mix(before | sign[middle + 1] << np.uint64(21) | after << np.uint64(42)) >> np.uint64(48)
    count = np.diff(np.searchsorted(middle, bounds))
    return code.astype(np.int64), count, count > 0


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Model:
    """Names of the languages and the probability of every trigram bucket in each."""

    def __init__(self, names: list[str], k: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        """From the count ``n`` of each language ``k`` and bucket that occur together."""
        self.names = names
        self.total = np.bincount(k, n, len(names)) + SMOOTHING * BUCKETS
        order = np.argsort(bucket, kind="stable")
        self.k, self.n = k[order].astype(np.int32), n[order].astype(np.float64)
        self.starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.table = None
        if len(names) <= DENSE_LANGUAGES:
            self.table = self.sparse(np.arange(BUCKETS))
            self.k = self.n = self.starts = None

    def sparse(self, buckets: np.ndarray) -> np.ndarray:
        """The probabilities of some buckets, one column for each language."""
        begin, count = self.starts[buckets], self.starts[buckets + 1] - self.starts[buckets]
        p = np.full((len(buckets), len(self.names)), SMOOTHING)
        at = A.expand(begin, count)
        p[np.repeat(np.arange(len(buckets)), count), self.k[at]] += self.n[at]
        return p / self.total

    def infer(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen languages and their proportions."""
        seen, n = np.unique(grams, return_counts=True)
        p, n = self.sparse(seen) if self.table is None else self.table[seen], n.astype(float)
        total = n.sum()
        single = n @ np.log(p)
        best = np.array([int(np.argmax(single))])
        share, gain = np.ones(1), single[best[0]]
        if len(self.names) == 1:
            return best, share
        all_share, _ = mixture(p, n, np.full(len(self.names), 1 / len(self.names)))
        for other in np.argsort(-all_share, kind="stable").tolist():
            if other in best:
                continue
            wider = np.append(best, other)
            start = np.append(share * 0.9, 0.1)
            new_share, likelihood = mixture(p[:, wider], n, start)
            if likelihood - gain <= PENALTY * 0.5 * np.log(total + 1):
                break
            best, share, gain = wider, new_share, likelihood
        return best, share

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        languages, share = self.infer(grams)
        score, _, name = min((-s, self.names[k], self.names[k]) for k, s in zip(languages.tolist(), share.tolist(), strict=True))
        return name, min(1.0, -score)


def mixture(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions, and the log-likelihood they reach."""
    total = n.sum()
    for _ in range(ROUNDS):
        share = share * ((n / (p @ share)) @ p) / total
    return share / share.sum(), float(n @ np.log(p @ share))


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count the trigrams of all labelled documents outside the held-out fold."""
    rows = docs.where(~held_out(F.col(id_column)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())

    def count(batches):
        held, size = [], 0  # code and count of a label's buckets, summed whenever they are many
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                grams, number, _ = trigrams(part.column("text"))
                label = np.searchsorted(names, part.column("lang").to_numpy(zero_copy_only=False).astype(str))
                held.append(np.unique(np.repeat(label, number) * BUCKETS + grams, return_counts=True))
                size += len(held[-1][0])
                if size > MOST_HELD:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    found = rows.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    # At most 65,536 sums for each language reach the driver, however many documents there are.
    return Model(names, *(found[c].to_numpy() for c in ("k", "bucket", "n")))


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes, inverse = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)
    k, bucket = codes // BUCKETS, codes % BUCKETS
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n)], ["k", "bucket", "n"])


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text).alias("text"))

    def work(batches):
        model = shared.value
        for batch in batches:
            for part in A.pieces_of(batch, "text"):
                names, scores = judge(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def judge(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    grams, number, some = trigrams(texts)
    names, scores, at = [], [], 0
    for n, known in zip(number.tolist(), some.tolist(), strict=True):
        name, score = model.predict(grams[at : at + n]) if known and model.names else (UNKNOWN, 0.0)
        names.append(name)
        scores.append(score)
        at += n
    return names, scores


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in which one language has at least half of the text; all columns stay."""
    model = train(docs, id_column, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part in A.pieces_of(batch, text):
                names, scores = judge(shared.value, part.column(text))
                keep = [a != UNKNOWN and b >= LEAST_SHARE for a, b in zip(names, scores, strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
