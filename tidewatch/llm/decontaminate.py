"""Operator 3, benchmark decontamination by a prefix-filtered set join.

Built from DataFrame functions alone. A window is ``width`` consecutive words of
an item (all words of a shorter item). A window that occurs in a document has all
its words there, so one necessary word is enough to find it: the rarest, by the
number of places that windows have it in. Documents meet windows on that word; the
word's position bounds where the window would begin and end, and the whole slice
is compared.

Words are runs of ASCII digits and letters (A-Z in lower case) and of all other
non-ASCII characters. Null or wordless texts have no words and no hits; a null
item_id still hits words but is not counted or listed as an item. Rows that
repeat a doc_id are judged by their own text; a repeated item counts once. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.frames import keyed, same_text, unkeyed
from tidewatch.session import materialize

WIDTH = 10
# The words of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Windows go to every task only while there are at most this many of them.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def item_windows(items: DataFrame, width: int = WIDTH, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Each distinct window with its words and the items that have it."""
    listed = items.select(F.col(id_column).alias("item_id"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    cut = listed.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at") + 1, F.lit(width)).alias("window")
    )
    return cut.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """print, doc_id, at, window, items: every place where a window occurs.

    ``docs`` has ``doc_id``, ``print`` and ``words``.
    """
    windows = materialize(windows.withColumn("w", F.xxhash64("window")), "windows")
    small = windows.count() <= BROADCAST_WINDOWS
    # The rarest word of each window and its first place there; of equally rare words a longer one.
    ranked = windows.select("w", F.posexplode("window").alias("offset", "word"))
    count = ranked.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", (-F.length("word")).alias("short"), "word", "offset")
    rarest = ranked.join(count, "word").groupBy("w").agg(F.min(order).alias("r"))
    keyed = windows.join(rarest, "w")
    keyed = keyed.select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "window", "items", "w")
    keyed = materialize(keyed, "prefixes")
    if small:
        met = docs.select("doc_id", "print", "words", F.posexplode("words").alias("place", "word")).join(F.broadcast(keyed), "word")
        return _verified(met)
    # Too many windows for every task: places meet windows first, then only documents with candidates bring their words.
    places = docs.select("doc_id", "print", F.posexplode("words").alias("place", "word"))
    met = places.join(keyed, "word").drop("word").withColumnsRenamed({"doc_id": "__id", "print": "__print"})
    texts = docs.join(met, docs["doc_id"].eqNullSafe(met["__id"]) & (docs["print"] == met["__print"]))
    return _verified(texts)


def _verified(met: DataFrame) -> DataFrame:
    start = F.col("place") - F.col("offset")
    fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
    same = F.slice("words", F.when(start >= 0, start + 1).otherwise(1), F.size("window")) == F.col("window")
    return met.where(fits & same).select("doc_id", "print", start.alias("at"), F.size("window").alias("length"), "items")


def contamination(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), words(F.col(text)).alias("words")
    )
    found = hits(rows, item_windows(items, width, item_column, item_text)).distinct()
    found = materialize(found, "hits")
    covered = F.explode(F.sequence("at", F.col("at") + F.col("length") - 1))
    places = found.select("doc_id", "print", covered.alias("place")).distinct().groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc_id", "print", F.explode("items").alias("item")).groupBy("doc_id", "print").agg(F.collect_set("item").alias("items"))
    mine = rows.select("doc_id", "print", F.size("words").cast("long").alias("n_words"))
    places = places.withColumnsRenamed({"doc_id": "__a", "print": "__b"})
    named = named.withColumnsRenamed({"doc_id": "__c", "print": "__d"})
    joined = mine.join(places, mine["doc_id"].eqNullSafe(places["__a"]) & (mine["print"] == places["__b"]), "left").join(
        named, mine["doc_id"].eqNullSafe(named["__c"]) & (mine["print"] == named["__d"]), "left"
    )
    listed = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents in which no window of an item occurs."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), words(F.col(text)).alias("words"))
    bad = hits(rows, item_windows(items, width)).select("doc_id", F.col("print").alias("mark")).distinct()
    mine = keyed(docs, id_column, text)
    return unkeyed(mine.join(bad, same_text(mine, bad), "left_anti"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[s:s + {WIDTH - 1}]) AS n, array_to_string(w[s:s + {WIDTH - 1}], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WIDTH - 1}, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, places.n, item_id FROM places JOIN win USING (k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
