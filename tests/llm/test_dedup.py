"""Substring dedup, suffix dedup and the n-gram join against plain Python."""

import random

import cases
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import ngram_join, sketch, substring, suffix
from tidemill.llm.graph import components


def distinct(docs):
    return sorted({(r[0], r[1]) for r in docs}, key=str)


@pytest.mark.parametrize("window", [400, 48])
def test_suffix(spark, window):
    got = suffix.remove_repeats(cases.frame(spark), window, 32 if window > 100 else 8).collect()
    docs = [(r[0], r[1]) for r in cases.rows()]
    want = cases.brute_suffix(docs, window)
    assert sorted(((r[0], r[1], r[2], r[3], cases.sha(bytes(r[4]))) for r in got), key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want)


def test_suffix_very_common_anchors(spark, monkeypatch):
    monkeypatch.setattr(sketch.Estimate, "very_common", lambda self, h: self.repeated(h))
    estimate = sketch.Estimate.very_common
    assert estimate
    docs = [(r[0], r[1]) for r in cases.rows()]
    rows = suffix.Stretch([(i, 0, (t or "").encode()) for i, (_, t) in enumerate(docs) if len((t or "").encode()) >= 48], 48, 8)
    hit = suffix.repeated_windows(np.concatenate([rows.data[a : a + n + 47] for a, n in zip(rows.first, rows.n, strict=True)]), rows.anchor - rows.first, rows.n, 48, 8)
    want = {}
    for i, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for k in range(len(b) - 47):
            want.setdefault(b[k : k + 48], []).append((i, k))
    want = {p for v in want.values() if len(v) > 1 for p in v}
    places = [(d, a + j) for d, a, n in zip(rows.doc.tolist(), rows.at.tolist(), rows.n.tolist(), strict=True) for j in range(n)]
    assert {p for p, h in zip(places, hit.tolist(), strict=True) if h} == want


def test_suffix_single_windows(spark, monkeypatch):
    """The path of very common anchors, for all of them."""
    monkeypatch.setattr(sketch, "HOT", 2)
    docs = [(r[0], r[1]) for r in cases.rows()]
    monkeypatch.setattr(sketch.Estimate, "__init__", _all_hot)
    got = suffix.remove_repeats(cases.frame(spark), 48, 8).collect()
    assert sorted(((r[0], r[1], r[2], r[3], cases.sha(bytes(r[4]))) for r in got), key=str) == sorted(cases.brute_suffix(docs, 48), key=str)


def _all_hot(self, sparse, bits):
    self.bits = bits
    self.twice = self.hot = np.full((2, max(1, 1 << bits >> 3)), 0xFF, np.uint8)


@given(st.lists(st.binary(min_size=16, max_size=16), min_size=1, max_size=40))
@settings(max_examples=30, deadline=None)
def test_multikey(rows):
    keys = np.frombuffer(b"".join(rows), ">u8").reshape(-1, 2).astype(np.uint64)
    assert [rows[i] for i in suffix.multikey(keys)] == sorted(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_substring(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(sketch.Estimate, "__init__", _all_hot)
    docs = distinct(cases.rows())
    got = substring.remove_repeats(cases.frame(spark)).collect()
    want = {w[0]: w for w in cases.brute_substring(docs, 20)}
    assert len(got) == len(cases.rows())
    for r in got:
        assert (r[0], r[1], r[2], cases.sha(bytes(r[3]))) == want[r[0]]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("key", [None, 7])
def test_rows_that_share_an_id(spark, monkeypatch, hot, key):
    """Texts without an id, or with one id, lose only what is repeated in themselves."""
    if hot:
        monkeypatch.setattr(sketch.Estimate, "__init__", _all_hot)
    rng = random.Random(3)
    prose = lambda: [f"w{rng.randrange(10**7)}" for _ in range(90)]
    passage = prose()
    texts = [" ".join([*passage, *prose()]), " ".join([*passage, *prose()]), " ".join(prose() + prose())]
    docs = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string").repartition(3)
    got = {bytes(r["kept"]).decode(): r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    whole, cut = set(texts), {" ".join(t.split()[90:]) for t in texts[:2]}
    assert sorted(got.values()) == [0, 0, 90] and texts[2] in got and len(set(got) & cut) == 1 and len(set(got) & whole) == 2
    got = sorted(((r[0], r[1], r[2], r[3], cases.sha(bytes(r[4]))) for r in suffix.remove_repeats(docs).collect()), key=str)
    want = sorted(cases.brute_suffix([(key, t) for t in texts], 400), key=str)
    assert got == want and sorted(w[2] > 0 for w in want) == [False, True, True]


def test_words_in_slices(monkeypatch):
    text = " ".join(f"w{i % 91} ñ{i}" for i in range(3000)).encode()
    whole = substring.Words([(1, 2), (1, 3)], [text, b" a\t b\n"])
    monkeypatch.setattr(substring, "SLICE", 100)
    cut = substring.Words([(1, 2), (1, 3)], [text, b" a\t b\n"])
    assert (cut.hashes == whole.hashes).all() and (cut.start == whole.start).all() and (cut.end == whole.end).all()
    assert cut.n.tolist() == whole.n.tolist() == [6000, 2]
    # The white space between words doesn't count.
    one, other = (substring.Words([(1, 2)], [t]) for t in (b"a b c a  b\tc", b"x a b c"))
    assert (one.digests(np.array([0, 3]), 3) == other.digests(np.array([1, 1]), 3)).all()


def twins(length: int = 1024) -> tuple[str, str]:
    """Two words that every polynomial hash modulo a power of two takes for the same."""
    bits = [bin(i).count("1") & 1 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("apart", [False, True])
def test_words_that_polynomials_confuse(spark, monkeypatch, hot, apart):
    """Different words are never taken for equal, within one task and between tasks."""
    if hot:
        monkeypatch.setattr(sketch.Estimate, "__init__", _all_hot)
    x, y = twins()
    start = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{start} {x}"), (2, f"{start} {y}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id") if apart else spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r["n_removed"] for r in substring.remove_repeats(docs).collect()] == [0, 0]
    assert [r["n_copies"] for r in ngram_join.near_duplicates(docs).collect()] == [1, 1]
    want = cases.brute_suffix(rows, 400)
    assert sorted((r[0], r[1], r[2], r[3], cases.sha(bytes(r[4]))) for r in suffix.remove_repeats(docs).collect()) == want


def test_exact_shingles():
    texts = [r[1] for r in cases.rows()]
    of, own = ngram_join.exact_shingles([(t or "").encode() for t in texts])
    sets = [cases.shingles(t) for t in texts]
    for i, a in enumerate(sets):
        assert (of == i).sum() == len(a)
        for j in range(i):
            assert len(np.intersect1d(own[of == i], own[of == j])) == len(a & sets[j])


def test_only_survivors_are_verified(monkeypatch):
    """Pairs that pruning drops have no links, though they be similar; the others have them."""
    text, low = " ".join(f"w{i}" for i in range(50)), bytes(ngram_join.HASHES)
    table = pa.table({"rep": [3, 1], "comp": [1, 1], "one": [0, 0], "two": [0, 0], "own": [0, 0], "low": [low, low], "text": [text, f"{text} x"]})
    assert ngram_join._verify(table).to_pydict() == {"node": [1, 3], "root": [1, 1], "links": [1, 1]}
    monkeypatch.setattr(ngram_join, "likely", lambda one, others: np.zeros(0, np.int64))
    assert not ngram_join._verify(table).num_rows


def check_join(spark, docs):
    got = {r[0]: (r[1], r[2], r[3]) for r in ngram_join.near_duplicates(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = cases.brute_join({-(2**63) if d is None else d: t for d, t in texts.items()})
    assert {(-(2**63) if d is None else d): tuple(-(2**63) if x is None else x for x in v) for d, v in got.items()} == want
    assert any(v[1] for v in want.values())


def test_join(spark):
    check_join(spark, cases.frame(spark))


def test_join_in_blocks(spark, monkeypatch):
    """Groups larger than a block, and bands larger than a task takes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BAND", 2)
    monkeypatch.setattr(ngram_join, "BAND_BLOCKS", 3)
    monkeypatch.setattr(ngram_join, "BAND_MOST", 4)
    check_join(spark, cases.frame(spark, 5))


@pytest.mark.parametrize(("block", "most"), [(3, 1 << 20), (1024, 2000)])
def test_join_in_bounded_groups(spark, monkeypatch, block, most):
    """Pairs of blocks of a large component never share a group, be it large by its classes or by its bytes."""
    verify = ngram_join._verify

    def one_pair(table):
        keys = set(zip(*(table.column(k).to_pylist() for k in ("comp", "one", "two")), strict=True))
        assert len(keys) == 1 and table.num_rows < 40
        return verify(table)

    monkeypatch.setattr(ngram_join, "_verify", one_pair)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", most, raising=False)
    words = [f"w{i}" for i in range(100)]
    check_join(spark, spark.createDataFrame([(i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(60)], "doc_id long, text string"))


def test_join_keeps_one(spark):
    docs = cases.frame(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {r[0]: r[1] for r in ngram_join.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, c in classes.items() if d == c}


def test_join_repeated_ids(spark):
    """Rows that repeat an id and its text count once; texts without an id, or with another's, are compared for themselves."""
    rng = random.Random(5)
    texts = [" ".join(f"{k}w{rng.randrange(10**6)}" for _ in range(80)) for k in range(5)]
    near = [t.replace(" ", " changed ", 1) for t in texts]
    rows = [(1, texts[0]), *[(2, near[0])] * 7, (1, near[1]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (None, near[2]), (9, near[2]), (None, texts[3]), (None, texts[4]), (6, near[4])]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, k int").repartition(4)
    want = [(1, 1, 1, 1), *[(2, 1, 1, 1)] * 7, (1, 1, 1, 1), (5, 1, 1, 1), *[(None, None, 1, 1)] * 2, (None, None, 1, 2), (9, None, 1, 2), (None, None, 0, 1), (None, None, 1, 1), (6, None, 1, 1)]
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(got) == 5 and {t.split("w")[0] for _, t in got} == set("01234")
    assert sorted((d for d, _ in got), key=str) == [1, 1, None, None, None]


def test_tolerance():
    """A pair at the threshold is pruned in hardly any case."""
    rng = np.random.default_rng(0)
    one = np.zeros(ngram_join.HASHES, np.uint8)
    others = (rng.random((20_000, ngram_join.HASHES)) > 0.8).astype(np.uint8)
    assert len(ngram_join.likely(one, others)) >= 19_995
    assert len(ngram_join.likely(one, (rng.random((20_000, ngram_join.HASHES)) > 0.3).astype(np.uint8))) < 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 90), (90, 7_000), (3, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 101: 90, 7_000: 90}


def test_empty(spark):
    none = cases.empty(spark)
    assert not suffix.remove_repeats(none).count()
    assert not substring.remove_repeats(none).count()
    assert not ngram_join.near_duplicates(none).count()


def confused() -> tuple[str, str]:
    """Two words of a and b to which both polynomials of ``hash_runs`` give equal values: blocks of the Thue-Morse word and its
    complement are equal modulo 2^64, and which of them to take so that the other modulus agrees too is found from both halves."""
    block = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    prime, half = (1 << 31) - 1, 11
    step = pow(0x3A5F1C7D, 2048, prime)
    signs = np.stack([(np.arange(3**half) // 3**k) % 3 - 1 for k in range(half)], axis=1)
    powers = np.array([pow(step, k, prime) for k in range(2 * half)], np.int64)
    left, right = ((signs * powers[k : k + half] % prime).sum(axis=1) % prime for k in (0, half))
    both = np.intersect1d(left, -right % prime, return_indices=True)
    i, j = next((i, j) for v, i, j in zip(*(x.tolist() for x in both), strict=True) if v)
    chosen = [*signs[i].tolist(), *signs[j].tolist()]
    other = block.translate(str.maketrans("ab", "ba"))
    return "".join(other if s > 0 else block for s in chosen), "".join(other if s < 0 else block for s in chosen)


def test_words_that_both_polynomials_confuse(spark):
    from tidemill.llm.anchors import hash_runs

    x, y = confused()
    data = np.frombuffer(f"{x} {y}".encode(), np.uint8)
    one, two = hash_runs(data, np.array([0, len(x) + 1]), np.array([len(x), len(data)]))
    assert x != y and one == two
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, x), (2, y), (3, x), (4, f"{long} {x}"), (5, f"{long} {y}"), (6, "r " * 300), (7, "r " * 301), (8, f" {y}\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.near_duplicates(df).collect()}
    assert got == cases.brute_join(dict(docs))
    assert got[1] == (1, 0, 2) and got[2] == (2, 0, 2) and got[6][2] == 2
    assert {r["doc_id"] for r in ngram_join.keep_one(df).collect()} == {1, 2, 4, 6}


@pytest.mark.parametrize("most", [3, 100_000])
def test_very_common_windows_are_sent_once_a_task(monkeypatch, most):
    """Two tasks over texts of which most share a passage, every anchor being very common; then the buckets."""
    from types import SimpleNamespace

    monkeypatch.setattr(substring, "STRETCH", 1500)
    monkeypatch.setattr(substring, "MOST_FIRSTS", most)
    every = lambda a: np.ones(len(a), bool)
    estimate = SimpleNamespace(value=SimpleNamespace(repeated=every, very_common=every))
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(35))
    docs = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), *[passage] * (i % 3), "end"])) for i in range(90)]
    rng.shuffle(docs)
    sent = []
    for part in (docs[:50], docs[50:]):
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([t for _, t in part])], names=["doc_id", "sub", "text"])
        for out in substring._send(estimate, 4, 20, 6)(iter([batch])):
            sent += out.to_pylist()
    live = sum(len(r["own"]) // 16 for r in sent)
    table = pa.Table.from_pylist(sent, pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("doc", "at", "n", "own"))]))
    found = []
    for bucket in set(table.column("bucket").to_pylist()):
        found += substring._settle(table.filter(pa.compute.equal(table.column("bucket"), bucket))).to_pylist()
    gone = {d: set() for d, _ in docs}
    for r in found:
        gone[r["doc_id"]].update(range(r["at"], r["at"] + r["n"] + 19))
    want = {d: n for d, _, n, _ in cases.brute_substring(docs, 20)}
    assert {d: len(g) for d, g in gone.items()} == want and sum(map(bool, want.values())) > 50
    if most > 3:  # each distinct window once a task at most
        distinct = {tuple(w[i : i + 20]) for _, t in docs for w in [t.split()] for i in range(len(w) - 19)}
        assert live <= 2 * len(distinct)
