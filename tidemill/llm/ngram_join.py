"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. Every text becomes a set of shingle hashes, of which its MinHash values are kept. Documents with equal sets are
   copies, and one of each class of copies stands for them. Equal words, by a 128-bit cryptographic digest of the words' own bytes,
   make equal sets. Where texts of different words have equal sets of hashes, a digest of the sorted shingles themselves tells whether
   their sets are equal, for hashes can be made to collide.
2. Classes that share a band (4 of 96 MinHash values) are candidates; a pair of similarity 0.8 shares none of
   the 24 bands in 3 cases of a million. In a band, MinHash values are compared 16 at a time, and a pair is
   dropped when the posterior probability that its similarity reaches the threshold falls below the
   tolerance (BayesLSH, uniform prior). What survives isn't listed pair by pair: a band's first class is
   compared with all others, and then only those that it didn't reach, so edges number less than classes.
   Large bands are compared in pairs of blocks, each in a group of its own.
3. Components of these edges hold every pair that may be similar. The texts of their classes meet there, in
   blocks of 1024 classes or 8 MB of text against each other, each pair of blocks in a group of its own, where
   pairs are pruned as above. Those that survive, and no others, are verified by the exact sizes of their
   intersections, over shingles of the words' own bytes and not of hashes. Only the number of links of each class
   and a spanning set of links leave the task.
4. Components of the verified links are the near-duplicate classes.

Defined cases: null and empty texts, and those without words, have no shingles and are copies of each other; very long texts are taken whole; a text of
one to four words is one shingle; one text of each class is compared, so rows that repeat a doc_id and its text
get equal results and count once; rows that repeat a doc_id with another text, as rows without one do, get the
results of their own texts; an empty table gives no rows; further columns are left alone.
"""

from collections.abc import Iterator
from fractions import Fraction
import functools
from hashlib import blake2b
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.anchors import groups, mixed, spread
from tidemill.llm.common import doc_key, drop_stored, key_back, keyed_texts, stored, text_key
from tidemill.llm.graph import components
from tidemill.llm.substring import slices, word_stretches

SHINGLE, THRESHOLD, TOLERANCE = 5, Fraction(4, 5), 1e-6
BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
#: Classes compared with each other in one task; classes of a block of a band, in up to ``BAND_BLOCKS`` blocks, and those
#: of a block beyond that. A band's m classes are sent once to each of its blocks, so their number is kept low.
BLOCK, BAND, BAND_BLOCKS, BAND_MOST = 1024, 512, 16, 100_000
#: Bytes of a component's texts that a block stands for, and of small components that are verified together.
BLOCK_BYTES = 8 << 20

_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def _starts(n: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document's number, first word and number of words of each shingle. n: words of each document."""
    many = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), many)
    return of, spread(np.cumsum(n) - n, many), np.minimum(n, shingle)[of]


def hashed_shingles(n: np.ndarray, words: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document's number and hash of each distinct shingle, in order of both. words: hashes of all words."""
    of, start, size = _starts(n, shingle)
    own = size.astype(np.uint64)
    for k in range(shingle):
        own = np.where(k < size, mixed(own) ^ words[np.minimum(start + k, len(words) - 1)], own) if len(own) else own
    own = mixed(own)
    order = np.lexsort((own, of))
    of, own = of[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (of[1:] != of[:-1]) | (own[1:] != own[:-1])
    return of[new], own[new]


def exact_shingles(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document's number and shingle of each distinct shingle, in order of both. Words are numbered by their bytes,
    and shingles by their words' numbers, so equal numbers mean equal words."""
    known: dict[bytes, int] = {}
    numbers, n = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for at, to in slices(text):
            own = text[at:to].split()
            numbers.append(np.fromiter((known.setdefault(w, len(known) + 1) for w in own), np.int64, len(own)))
            n[i] += len(own)
    words, wide = np.concatenate(numbers), len(known) + 1
    of, start, size = _starts(n, shingle)
    own, most = np.zeros(len(of), np.int64), 1
    for k in range(shingle):
        if most * wide >= 1 << 62:
            own = np.unique(own, return_inverse=True)[1]
            most = len(own)
        own = own * wide + (np.where(k < size, words[np.minimum(start + k, len(words) - 1)], 0) if len(own) else own)
        most *= wide
    own = np.unique(own, return_inverse=True)[1]
    wide = max(1, len(own))
    both = np.unique(of * wide + own)
    return both // wide, both % wide


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words in word_stretches(batches):
        docs = words.keys
        of, own = hashed_shingles(words.n, words.hashes)
        size = np.bincount(of, minlength=len(docs))
        full = np.flatnonzero(size)
        edges = (np.cumsum(size) - size)[full]
        mins = np.zeros((len(docs), HASHES), np.uint64)
        if len(full):
            for k, f in enumerate(_FACTORS):
                mins[full, k] = np.minimum.reduceat(own * f, edges)
        raw, to = own.astype("<u8").tobytes(), np.cumsum(size) * 8
        sums = np.frombuffer(b"".join([blake2b(raw[b - 8 * n : b], digest_size=16).digest() for n, b in zip(size.tolist(), to.tolist(), strict=True)]), "<i8").reshape(-1, 2).T
        keys = np.zeros((len(docs), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mixed(keys + mins[:, r::ROWS])
        keys += np.arange(BANDS, dtype=np.uint64)
        low = (mixed(mins) & np.uint64(0xFF)).astype(np.uint8)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(k, pa.int64()) for k in docs.T), pa.array(size, pa.int64()), *(pa.array(s, pa.int64()) for s in (*sums, *words.wholes().T)), lists, pa.array([x.tobytes() for x in low], pa.binary())],
            names=["doc_id", "sub", "bytes", "n", "d1", "d2", "w1", "w2", "bands", "low"],
        )


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s1, s2 beside the keys: the digest of a text's distinct shingles in order. Words hold no white space, so spaces and line ends part them."""
    for batch in batches:
        own = []
        for text in batch.column("text"):
            words = text.as_py().encode().split()
            shingles = {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
            own.append(blake2b(b"\n".join(sorted(shingles)), digest_size=16).digest())
        sums = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
        keep = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sums[:, 0], pa.int64()), pa.array(sums[:, 1], pa.int64())], names=[*keep.schema.names, "s1", "s2"])


@functools.cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After 16, 32, ... values: the fewest matches with which a pair stays. Values of 8 bits also match by chance."""
    grid = [(i + 0.5) / 1000 for i in range(1000)]
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        for m in range(k + 1):
            like = [m * log(p) + (k - m) * log(1 - p) for p in (s + (1 - s) / 256 for s in grid)]
            top = max(like)
            weight = [exp(x - top) for x in like]
            if sum(w for s, w in zip(grid, weight, strict=True) if s >= threshold) >= tolerance * sum(weight):
                out.append(m)
                break
    return tuple(out)


def likely(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the others (rows of MinHash values) may be similar to one; fewer are looked at with each step."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for step, least in enumerate(least_matches(float(THRESHOLD), TOLERANCE)):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (others[left, part] == one[part]).sum(axis=1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
    return left


def _band_edges(table: pa.Table) -> pa.Table:
    """Edges that connect the classes of each band as all its likely pairs would."""
    key = np.lexsort(tuple(table.column(k).to_numpy() for k in ("rep", "part", "key")))
    table = table.take(pa.array(key))
    rep = table.column("rep").to_numpy()
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)
    a, b = [], []
    for lo, hi in groups(*(table.column(k).to_numpy() for k in ("key", "part"))):
        group, own, m = low[lo:hi], rep[lo:hi], hi - lo
        label = np.arange(m)
        for i in range(m):
            if i and not label[i]:
                continue  # the first class meets all; later ones do so only if they aren't connected to it yet
            found = likely(group[i], group)
            other, at = np.unique(label[found], return_index=True)
            new = other != label[i]
            a.append(np.full(int(new.sum()), own[i]))
            b.append(own[found[at[new]]])
            label[np.isin(label, other)] = other[0]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})


def _blocks(df: DataFrame, n: Column, key: str, parts: int, *group: str) -> DataFrame:
    """Adds one, two and own (numbers of blocks) and bucket: rows of a group go to each pair of its n blocks.

    Each pair of blocks has a bucket of its own, however many they are; groups of one block are dealt to ``parts`` buckets.
    """
    df = df.withColumn("_n", n.cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(F.least("own", x).alias("one"), F.greatest("own", x).alias("two")))
    df = df.withColumn("_p", F.explode(pairs)).withColumns({"one": F.col("_p.one"), "two": F.col("_p.two")})
    few = F.pmod(F.xxhash64(*group), F.lit(parts).cast("long"))
    return df.withColumn("bucket", F.when(F.col("_n") > 1, F.xxhash64(*group, "one", "two")).otherwise(few)).drop("_n", "_p")


def _verify(table: pa.Table) -> pa.Table:
    """node, root, links: verified links of classes, counted, and each class's root among those of its task."""
    sort = np.lexsort(tuple(table.column(k).to_numpy() for k in ("rep", "two", "one", "comp")))
    table = table.take(pa.array(sort))
    rep = table.column("rep").to_numpy()
    keys = [table.column(k).to_numpy() for k in ("comp", "one", "two")]
    own_block = table.column("own").to_numpy()
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)
    of, shingles = exact_shingles([x.as_py().encode() for x in table.column("text")])
    size = np.bincount(of, minlength=len(rep))
    first = np.cumsum(size) - size
    inside = np.zeros(int(shingles.max(initial=0)) + 1, bool)
    out = [[], [], []]
    for lo, hi in groups(*keys):
        cross = keys[1][lo] != keys[2][lo]
        links, root = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
        for i in range(lo, hi):
            others = np.arange(i + 1, hi)
            if cross:
                others = others[own_block[i + 1 : hi] != own_block[i]]
            others = others[likely(low[i], low[others])]
            if not len(others):
                continue
            mine = shingles[first[i] : first[i] + size[i]]
            inside[mine] = True
            both = np.add.reduceat(inside[shingles[spread(first[others], size[others])]].astype(np.int64), np.cumsum(size[others]) - size[others])
            inside[mine] = False
            union = size[i] + size[others] - both
            near = others[THRESHOLD.denominator * both >= THRESHOLD.numerator * union] - lo
            if len(near):
                links[i - lo] += len(near)
                links[near] += 1
                met = np.unique(root[np.append(near, i - lo)])
                root[np.isin(root, met)] = met[0]
        linked = np.flatnonzero(links)
        for x, v in zip(out, (rep[lo:hi][linked], rep[lo:hi][root[linked]], links[linked]), strict=True):
            x.append(v)
    return pa.table({k: pa.array(np.concatenate(v), pa.int64()) for k, v in zip(("node", "root", "links"), out, strict=True)})


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id and sub of each row, class_id and class_sub (the smallest of its near-duplicate class), n_links, n_copies."""
    spark, rows = docs.sparkSession, keyed_texts(docs)
    sized = rows.select("doc_id", "sub", F.octet_length("text").cast("long").alias("bytes"), "text")
    signed = stored(sized.mapInArrow(_signatures, "doc_id long, sub long, bytes long, n long, d1 long, d2 long, w1 long, w2 long, bands array<long>, low binary"), "signatures")
    hashed, alike = ["n", "d1", "d2"], ["n", "d1", "d2", "s1", "s2"]
    # Sets of hashes that several runs of words have; one text of each run is looked at.
    run = F.struct("w1", "w2")
    doubtful = signed.groupBy(*hashed).agg(F.min(run).alias("one"), F.max(run).alias("other")).filter("one <> other").select(*hashed)
    texts = signed.join(doubtful, hashed, "left_semi").groupBy(*hashed, "w1", "w2").agg(F.min(F.struct("doc_id", "sub")).alias("k")).select(*hashed, "w1", "w2", "k.*")
    texts = texts.join(rows, ["doc_id", "sub"]).dropDuplicates([*hashed, "w1", "w2"]).select(*hashed, "w1", "w2", "text")
    apart = stored(texts.mapInArrow(_told_apart, "n long, d1 long, d2 long, w1 long, w2 long, s1 long, s2 long"), "apart")
    signed = signed.join(apart, [*hashed, "w1", "w2"], "left").fillna(0, ["s1", "s2"])
    least = F.min(F.struct("doc_id", "sub", "bytes")).alias("least")
    classes = signed.groupBy(*alike).agg(least, F.count_distinct("doc_id").alias("n_copies"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    # rep is a class's number, and doc_id and sub say which text is compared for it.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), *alike, "least.*", "n_copies", "bands", "low"), "copies")

    banded = classes.filter("n > 0").select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    banded = stored(banded.join(shared, "key"), "bands")
    tasks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = F.least(F.ceil(F.col("size") / BAND), F.greatest(F.lit(BAND_BLOCKS), F.ceil(F.col("size") / BAND_MOST)))
    met = _blocks(banded.join(classes.select("rep", "low"), "rep"), blocks, "rep", max(4 * tasks, banded.count() // BAND_MOST), "key")
    edges = met.select("bucket", "key", (F.col("one") * 100_000 + F.col("two")).alias("part"), "rep", "low").groupBy("bucket").applyInArrow(_band_edges, "a long, b long")

    nodes = _members(components(edges)).toDF("rep", "comp")
    drop_stored(banded)
    nodes = stored(nodes.join(classes.select("rep", "doc_id", "sub", "low", "bytes"), "rep"), "nodes")
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"), F.sum("bytes").alias("size_bytes"))
    parts = max(4 * tasks, (nodes.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES)
    # Rows that repeat the text of a class go here, before any blocks.
    own = rows.join(nodes.join(sizes, "comp"), ["doc_id", "sub"]).drop("doc_id", "sub").dropDuplicates(["rep"])
    own = _blocks(own, F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("size_bytes") / BLOCK_BYTES), F.lit(1)), "rep", parts, "comp")
    # The work grows faster than the bytes, so the tasks' number is set rather than coalesced.
    own = own.select("bucket", "comp", "one", "two", "own", "rep", "low", "text").repartition(tasks, "bucket")
    verified = stored(own.groupBy("bucket").applyInArrow(_verify, "node long, root long, links long"), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    final = _members(components(verified.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    first = final.join(classes.select("rep", "doc_id", "sub"), F.col("node") == F.col("rep")).groupBy("root").agg(F.min(F.struct("doc_id", "sub")).alias("first"))
    linked = final.join(first, "root").join(links, "node").select(F.col("node").alias("rep"), "first", "links")
    found = classes.select("rep", *alike, "doc_id", "sub", "n_copies").join(linked, "rep", "left")
    first = F.coalesce("first", F.struct("doc_id", "sub"))
    found = found.select(*alike, first["doc_id"].alias("class_id"), first["sub"].alias("class_sub"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    return signed.select("doc_id", "sub", *alike).join(found, alike).drop(*alike)


def _members(stars: DataFrame) -> DataFrame:
    """node and root, for roots too."""
    return stars.unionByName(stars.select("root", "root").distinct().toDF("node", "root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of each document.

    class_id is the smallest doc_id of the documents connected by links; n_links the number of different
    shingle sets of other documents that are similar enough; n_copies the documents with an equal set.
    """
    return _classified(docs).select(key_back(F.col("doc_id")).alias("doc_id"), key_back(F.col("class_id")).alias("class_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each near-duplicate class one row, of the document with the smallest id, with all its columns."""
    keys = ["_k_doc", "_k_sub"]
    kept = _classified(docs).filter("doc_id = class_id and sub = class_sub").select("doc_id", "sub").distinct().toDF(*keys)
    rows = docs.withColumns({"_k_doc": doc_key(), "_k_sub": text_key()})
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
