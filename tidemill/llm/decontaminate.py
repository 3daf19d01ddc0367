"""Benchmark decontamination with DataFrame functions alone.

The distinct windows of the benchmark (13 words, or a whole shorter item) form a hash set that is broadcast
only if it is counted to be small (``most`` windows); over that the same join shuffles by window. Texts are
split once. At each place of a document the hash of a window's first, middle and last word is looked up first;
only where a benchmark window has that hash is the window put together and met with the set as a whole string, so a
hit is verified by the match itself. Hits alone, as numbers of windows, are shuffled, by document (doc_id and
its text's hash).

Defined cases: null and empty texts have no words and are never hit; very long texts are looked through whole, place by
place; items without words have no window; repeated rows
of a doc_id get equal results, and rows that repeat a doc_id with another text, as rows without one do, are
documents of their own; an empty
benchmark hits nothing; further columns are left alone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import doc_key, key_back, keyed_texts, stored, text_key

WINDOW = 13
#: A broadcast of so many windows takes some 200 MB at most.
MOST_BROADCAST = 1_000_000
_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lower-casing A to Z: runs of 0-9, a-z and characters beyond ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _CUT), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, window: the distinct windows of each item; for fewer words than the window, the whole item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(0), F.size("w") - n)
    runs = items.select(F.coalesce("item_id", F.lit("")).alias("item_id"), n.alias("len"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i + 1, n), " "))).alias("window"))
    return runs.distinct()


def numbered(runs: DataFrame) -> DataFrame:
    """id, len, window and seed of the distinct windows, stored; the seed is the hash of three of a window's words."""
    w, n = F.split("window", " "), F.col("len")
    distinct = runs.select("len", "window").distinct().withColumn("seed", _seed(n, lambda i: F.get(w, i)))
    return stored(distinct.select(F.monotonically_increasing_id().alias("id"), "len", "window", "seed"), "benchmark-windows")


def _seed(n: Column, word) -> Column:
    return F.xxhash64(n, word(F.lit(0)), word(F.shiftright(n, 1)), word(n - 1))


def scanned(docs: DataFrame, windows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, sub, n_words, at, len, id for each place of a document where a benchmark window occurs; and for each
    row of docs, hit or not, one row without an id."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # 1 to 13: bounded
    w, at, n, size = F.col("w"), F.col("at"), F.col("len"), F.col("n_words")
    split = keyed_texts(docs).select("doc_id", "sub", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    none = F.lit(None).cast("long").alias("id")
    if not lengths:
        return split.select("doc_id", "sub", "n_words", F.lit(0).alias("at"), F.lit(0).alias("len"), none)
    # The place behind the last word is the row's own.
    placed = split.select("*", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    placed = placed.select("*", F.explode(F.when(at < size, F.array(*map(F.lit, lengths))).otherwise(F.array(F.lit(0)))).alias("len")).filter(at + n <= size)
    window = F.array_join(F.slice("w", at + 1, n), " ")
    if windows.limit(most + 1).count() > most:
        met = placed.filter(at < size).select("doc_id", "sub", "n_words", "at", "len", window.alias("window")).join(windows.select("len", "window", "id"), ["len", "window"])
        return placed.filter(at == size).select("doc_id", "sub", "n_words", "at", "len", none).unionByName(met.drop("window"))
    seeds = windows.select("seed", F.lit(True).alias("seen")).distinct()
    placed = placed.withColumn("seed", F.when(at < size, _seed(n, lambda i: F.get(w, at + i)))).join(F.broadcast(seeds), "seed", "left").filter((at == size) | F.col("seen"))
    placed = placed.withColumn("window", F.when(at < size, window)).join(F.broadcast(windows.select("len", "window", "id")), ["len", "window"], "left")
    return placed.filter((at == size) | F.col("id").isNotNull()).select("doc_id", "sub", "n_words", "at", "len", "id")


def _spans(by_doc: DataFrame) -> DataFrame:
    """From the sorted places of words that are hit to the ranges that they form."""
    c = F.col("words")
    first = F.filter(c, lambda x, i: F.coalesce(x - F.get(c, i - 1), F.lit(2)) > 1)
    last = F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1) - x, F.lit(2)) > 1)
    return by_doc.withColumn("spans", F.zip_with(first, last, lambda a, b: F.struct(a.alias("from"), (b + 1).alias("to"))))


def judged(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, most: int = MOST_BROADCAST) -> DataFrame:
    """What ``report`` says, with the keys of the rows."""
    runs = stored(benchmark_windows(benchmark, window), "benchmark-items")
    windows = numbered(runs)
    found = stored(scanned(docs, windows, most), "benchmark-hits")
    hits = found.filter("id is not null")
    # A document's places fit in a row, being fewer than its words for each length of window.
    places = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "len")), lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1))))
    by_doc = _spans(hits.groupBy("doc_id", "sub").agg(F.array_sort(places).alias("words")))
    named = hits.select("doc_id", "sub", "id").distinct().join(windows.select("id", "len", "window"), "id").join(runs, ["len", "window"])
    items = named.groupBy("doc_id", "sub").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    by_doc = by_doc.select("doc_id", "sub", "spans", F.size("words").cast("long").alias("hit")).join(items, ["doc_id", "sub"])
    out = found.filter("id is null").select("doc_id", "sub", "n_words").join(by_doc, ["doc_id", "sub"], "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select("doc_id", "sub", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, most: int = MOST_BROADCAST) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items, spans, contaminated (hit in 1 of ``share`` words or more)."""
    return judged(docs, benchmark, share, window, most).withColumn("doc_id", key_back(F.col("doc_id"))).drop("sub")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    keys = ["_k_doc", "_k_sub"]
    gone = judged(docs, benchmark, share).filter("contaminated").select("doc_id", "sub").distinct().toDF(*keys)
    rows = docs.withColumns({"_k_doc": doc_key(), "_k_sub": text_key()})
    return rows.join(gone, keys, "left_anti").drop(*keys)
