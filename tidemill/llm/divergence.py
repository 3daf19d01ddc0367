"""Source divergence audit: how the terms of each source differ from those of the other sources of its language.

Terms are counted in tasks by packed words. A term of up to 8 bytes is one 64-bit number, one of up to 16 bytes two; they are
sorted by digits of 16 bits from the last to the first (each a stable radix sort) and counted by runs, with the
number of their source and the documents in which they occur. Longer terms form a bucket of their own, sorted as
bytes. A term holds no zero byte, so numbers tell terms of all lengths apart.

Counts are added up by (lang, source, term), then each (lang, term) is held against the least number of documents. Terms, one source's
part of them, and pairs of sources are shuffled; pairs of sources are compared in blocks of 256 sources by dense arrays of
some terms at a time, and only sums leave the task. What pairs have where neither source has a term is one product.

Defined cases: null texts, languages and sources are empty ones; a row is a document, so repeated rows count again; very long texts and
terms are taken whole; a group without terms has its rows of pairs; a language without kept terms has the value 0 for each pair; one with a single
source has no rows of pairs; an empty table gives no rows; further columns are left alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import stored

#: A kept term's documents at least; ranks of terms; the whole that shares are parts of.
DOCUMENTS, TERMS, WHOLE = 3, 200, 1_000_000_000
#: Bytes of text counted together; sources compared in one block; numbers of one dense array.
STRETCH, SOURCES, DENSE = 4 << 20, 256, 1 << 21
_LETTER = np.ones(256, bool)
_LETTER[: 0x41] = _LETTER[0x5B:0x61] = _LETTER[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_COUNTS = "lang string, source string, term string, n long, docs long"


def by_digits(order: np.ndarray, key: np.ndarray, digits: int = 4) -> np.ndarray:
    """The order sorted by a key's 16-bit digits, equal keys as before."""
    for shift in range(0, 16 * digits, 16):
        digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and digit.max() != digit.min():
            order = order[np.argsort(digit[order], kind="stable")]  # a radix sort, for numbers of 16 bits
    return order


def runs(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, rows and documents of each run of equal keys, in rows sorted by keys and document."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    other = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(other.astype(np.int64), first)


def _strings(words: np.ndarray) -> pa.Array:
    """Terms of packed words: a row of big-endian numbers each."""
    raw = words.astype(">u8").view(np.uint8).reshape(len(words), 8 * words.shape[1])
    used = raw != 0
    ends = np.concatenate(([0], np.cumsum(used.sum(axis=1)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[used].tobytes()))


def _counted(groups: list[tuple[str, str]], of: list[int], texts: list[bytes]) -> pa.RecordBatch:
    """Counts of a stretch. of: the number of each text's group."""
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0" * 17, np.uint8)]
    inside = np.concatenate(([False], _LETTER[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    group = np.array(of, np.int64)[doc].astype(np.uint64)
    found = []
    for words, here in ((1, size <= 8), (2, (size > 8) & (size <= 16))):
        at, own, who, d = start[here], size[here], group[here], doc[here]
        packed = np.lib.stride_tricks.sliding_window_view(data, 8 * words)[at].copy()
        packed[np.arange(8 * words) >= own[:, None]] = 0
        keys = packed.view(">u8").astype(np.uint64)
        order = by_digits(np.arange(len(at)), who, 2)  # documents are in order already
        for k in reversed(range(words)):
            order = by_digits(order, keys[:, k])
        first, n, docs = runs([*(keys[order, k] for k in range(words)), who[order]], d[order])
        found.append((who[order][first], _strings(keys[order][first]), n, docs))
    long = np.flatnonzero(size > 16)
    raw = data.tobytes()
    terms = sorted((raw[a : a + n], g, d) for a, n, g, d in zip(start[long].tolist(), size[long].tolist(), group[long].tolist(), doc[long].tolist(), strict=True))
    number = np.cumsum([0, *(x[0] != y[0] for x, y in zip(terms[:-1], terms[1:], strict=True))])[: len(terms)]
    who, d = (np.array([t[i] for t in terms], np.int64) for i in (1, 2))
    first, n, docs = runs([number, who], d)
    found.append((who[first], pa.array([terms[i][0].decode() for i in first.tolist()], pa.string()), n, docs))
    who = np.concatenate([f[0].astype(np.int64) for f in found])
    names = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(who)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*names, pa.concat_arrays([f[1] for f in found]), *(pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (2, 3))], names=["lang", "source", "term", "n", "docs"])


def _count(stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, of, texts, size = {}, [], [], 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                of.append(groups.setdefault((lang, source), len(groups)))
                texts.append(text.as_py().encode())
                size += len(texts[-1])
                if size >= stretch:
                    yield _counted(list(groups), of, texts)
                    groups, of, texts, size = {}, [], [], 0
        if texts:
            yield _counted(list(groups), of, texts)

    return run


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + terms)), in whole numbers of any size."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _sums(sources: int, dense: int):
    """Of terms of a pair of blocks of sources: what each pair of sources has beyond what it has where both lack a term, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}

        def out():
            for (lang, a, b), m in held.items():
                i, j = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + a * sources, pa.int32()), pa.array(j + b * sources, pa.int32()), pa.array(m[i, j], pa.int64())], names=["lang", "one", "two", "more"])
            held.clear()

        def spread_out(none: np.ndarray, cells: pa.Array) -> np.ndarray:
            """A row per term: what each source has of it. cells: (nth, p) of the sources that have it."""
            m = np.tile(none, (len(cells), 1))
            flat = cells.flatten()
            m[np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths().fill_null(0), np.int64)), flat.field("nth").to_numpy()] = flat.field("p").to_numpy()
            return m

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b")), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                p0, q0 = (np.array(batch.column(c)[lo].as_py(), np.int64) for c in ("none_a", "none_b"))
                base = (p0[:, None] - q0) ** 2 // q0
                if keys[lo] not in held:
                    if len(held) == 32:
                        yield from out()
                    held[keys[lo]] = np.zeros(base.shape, np.int64)
                step = max(1, dense // base.size)
                for at in range(lo, hi, step):
                    n = min(step, hi - at)
                    p, q = (spread_out(x, batch.column(c).slice(at, n)) for x, c in ((p0, "cells_a"), (q0, "cells_b")))
                    held[keys[lo]] += ((p[:, :, None] - q[:, None, :]) ** 2 // q[:, None, :] - base).sum(axis=0)
        yield from out()

    return run


def audit(docs: DataFrame, least: int = DOCUMENTS, ranks: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: by ``pair`` the other sources of the language, by ``term`` the terms that are commoner in the source than in the language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), empty("text"))
    total = lambda c, over=None: (F.sum(c).over(over) if over else F.sum(c)).cast("long")
    counts = rows.mapInArrow(_count(STRETCH), _COUNTS).groupBy("lang", "source", "term").agg(total("n").alias("n"), total("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    whole = counts.select("lang", "source", "term", "n", total("docs", term).alias("docs"), total("n", term).alias("all"), (F.row_number().over(term.orderBy("source")) == 1).cast("long").alias("first"))
    kept = stored(whole.filter(F.col("docs") >= least).drop("docs"), "terms")

    lang = W.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(total("n").alias("in_group"), total("first").alias("firsts")), ["lang", "source"], "left").fillna(0)
    groups = groups.select("lang", "source", "in_group", total("firsts", lang).alias("terms"), total("in_group", lang).alias("in_lang"), (F.row_number().over(lang.orderBy("source")) - 1).alias("nth"), F.count("*").over(lang).alias("sources"))
    none = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("in_group"), F.col("terms")))
    groups = stored(groups.withColumn("none", none), "sources")

    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("in_group"), F.col("terms")), "q": share(F.col("all"), F.col("in_lang"), F.col("terms"))})
    group = W.partitionBy("lang", "source")
    commoner = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    commoner = commoner.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= ranks)

    block = F.floor(F.col("nth") / SOURCES).cast("int")
    cell = F.struct((F.col("nth") % SOURCES).cast("int").alias("nth"), "p").alias("cell")
    cells = shares.select("lang", "term", block.alias("own"), F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / SOURCES).cast("int"))).alias("other"), cell)
    # A row for each pair of blocks of which one has the term: its cells in the first and in the second.
    sides = F.explode(F.when(F.col("own") == F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2))))
    cells = cells.select("lang", "term", "own", "other", "cell", sides.alias("side")).select("lang", "term", F.when(F.col("side") == 2, F.col("other")).otherwise(F.col("own")).alias("a"), F.when(F.col("side") == 2, F.col("own")).otherwise(F.col("other")).alias("b"), F.when(F.col("side") < 2, F.col("cell")).alias("cell_a"), F.when(F.col("side") != 1, F.col("cell")).alias("cell_b"))
    cells = cells.groupBy("lang", "a", "b", "term").agg(F.collect_list("cell_a").alias("cells_a"), F.collect_list("cell_b").alias("cells_b"))
    none = groups.filter("terms > 0").groupBy("lang", block.alias("a")).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "none"))), lambda x: x["none"]).alias("none_a"))
    cells = cells.join(none, ["lang", "a"]).join(none.toDF("lang", "b", "none_b"), ["lang", "b"])
    more = cells.select("lang", "a", "b", "none_a", "none_b", "cells_a", "cells_b").mapInArrow(_sums(SOURCES, DENSE), "lang string, one int, two int, more long")
    more = more.groupBy("lang", "one", "two").agg(total("more").alias("more"))

    one = groups.select("lang", "source", "terms", F.col("none").alias("p"), F.col("nth").alias("one"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q"), F.col("nth").alias("two"))
    pairs = one.join(two, "lang").filter("one <> two").join(more, ["lang", "one", "two"], "left")
    value = F.coalesce(F.col("terms") * _apart(F.col("p"), F.col("q")) + F.coalesce("more", F.lit(0).cast("long")), F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    return pairs.unionByName(commoner)
