"""Tokens, range coder, packing, sharding, WARC and the pipeline."""

from collections import Counter
import hashlib
import random
import zlib

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import binary, packing, rangecoder, registry, shard, tokens, warc

PATH = registry.tokenizer_path()


def library(texts):
    return [np.array([*e.ids, 1], "<u4") for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_like_library():
    rng = random.Random(1)
    alphabet = "aAzZéÉßñ'0 9.,<|>\t\n\x1c\xa0́ΣİſK½日🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(rng.choice("aAéÉ'sStTrReEvVlLmMdD 0!") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["w" * n for n in range(20, 40)] + ["", "don't DON'T 'S ''s x'll", "<|endoftext|> a<|endoftext|>b <|x", "ΑΣ Σας", "ẞß Ÿÿ", "a\x00b"]
    for got, want in zip(tokens.words(PATH).encode(texts), library(texts), strict=True):
        assert got == want[:-1].tobytes()


def test_tokens_long_text_and_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 50)
    monkeypatch.setattr(tokens, "CACHE", 20)
    text = " ".join(f"Word{i % 37}, ñandú" for i in range(400))
    assert next(tokens.Words(PATH).encode([text])) == library([text])[0][:-1].tobytes()
    few = tokens.Words(PATH)
    for i in range(0, 400, 3):  # the table is emptied again and again
        own = f"x{i} ñandú y{i}z w{i % 7}"
        assert next(few.encode([own])) == library([own])[0][:-1].tobytes() and few.table.n <= 20


@given(st.lists(st.integers(0, 999), max_size=700))
@settings(max_examples=25, deadline=None)
def test_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (rangecoder.unpack_block(rangecoder.pack_block([5], [len(ids)], ids, 1000), 1000)[2] == ids).all()


def test_coder_size_and_damage():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.4, 60_000) % 49408
    block = rangecoder.pack_block([1, 2], [50_000, 10_000], ids, 49408)
    docs, sizes, back = rangecoder.unpack_block(block, 49408)
    assert (back == ids).all() and docs == [1, 2] and sizes == [50_000, 10_000] and len(block) < 1.4 * 60_000
    assert len(rangecoder.pack_block([1], [60_000], np.tile(ids[:500], 120), 49408)) < len(block) / 2
    for at in (3, 12, 100, len(block) - 1):
        with pytest.raises((ValueError, zlib.error)):
            rangecoder.unpack_block(block[:at] + bytes([block[at] ^ 4]) + block[at + 1 :], 49408)


def test_ids_table(spark):
    docs = [(r[0], r[1]) for r in cases.rows()]
    for block in (64, 1 << 20):
        out = binary.read_ids(binary.write_ids(cases.frame(spark), PATH, block=block)).orderBy("start").collect()
        want = dict(zip([d for d, _ in docs], library([t for _, t in docs]), strict=True))
        at = 0
        for r in out:
            ids = np.frombuffer(r["ids"], "<u4")
            assert r["start"] == at and r["n_tokens"] == len(ids) and (ids == want[r["doc_id"]]).all()
            at += len(ids)
        ids = [r["doc_id"] for r in out]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == len(docs)
    assert not binary.read_ids(binary.write_ids(cases.empty(spark), PATH)).count()


@pytest.mark.parametrize("window", [2048, 32])
def test_packing(spark, window):
    docs = [(r[0], r[1]) for r in cases.rows()]
    want = {d: i for (d, _), i in zip(docs, library([t for _, t in docs]), strict=True)}
    out = packing.pack(cases.frame(spark), PATH, window, with_ids=True).collect()
    windows, covered = {}, Counter()
    for r in out:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["ids"] == ids.tobytes()
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(windows) == list(range(len(windows)))
    rows = Counter(d for d, _ in docs)
    assert covered == {d: n * len(want[d]) for d, n in rows.items()}
    assert not packing.pack(cases.empty(spark), PATH).count()


def laid_out(counts, window, slack):
    """Every piece of some counts put where the layout says: the windows' pieces (offset, length), and the parts of each piece."""
    places = packing.layout(packing.patterns(counts, window, slack), counts)
    windows, parts = {}, {}
    for length, n in counts.items():
        for rank in range(n):
            own, k, r = [], length, rank
            while True:
                at = max((p for p in places[k] if p.first <= r), key=lambda p: p.first)
                nth = r - at.first
                if not at.head:
                    break
                windows.setdefault(at.sequence + nth, []).append((at.offset, at.head))
                own.append(at.head)
                k, r = at.tail, at.tail_first + nth
            windows.setdefault(at.sequence + nth // at.n, []).append((at.offset + nth % at.n * k, k))
            parts[length, rank] = [*own, k]
    for pieces in windows.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= window
    assert sorted(windows) == list(range(len(windows))) and all(sum(p) == length for (length, _), p in parts.items())
    return [sum(n for _, n in pieces) for _, pieces in sorted(windows.items())]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_patterns(counts, slack):
    filled = laid_out(counts, 64, slack)
    assert sum(filled) == sum(k * n for k, n in counts.items())
    assert sum(64 - n > slack for n in filled) <= 1


@pytest.mark.parametrize("counts", [{1025: 400}, {1100: 300}, {1500: 300}, {2048: 5, 700: 500}, {1025: 99, 1100: 77, 1999: 50, 3: 1}, {k: k % 7 for k in range(1, 2048, 3)}, {2047: 300}])
def test_padding_is_little_for_any_lengths(counts):
    filled = laid_out(counts, 2048, packing.SLACK)
    assert sum(2048 - n for n in filled[:-1]) <= 0.004 * 2048 * len(filled) and 2048 * len(filled) - sum(filled) < 0.02 * 2048 * len(filled)


def test_patterns_stay_few():
    counts = {k: 1_000_000 // k for k in range(1, 2049)}
    assert len(packing.patterns(counts)) < 10_000 and len(packing.patterns({k: 10**9 + k for k in (1025, 1100, 1500, 2047)})) < 500


def test_fill_is_best():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing._fill(room, counts)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in used.items())


def test_little_padding(spark, sf_dir):
    out = registry.op10_packing(spark, sf_dir).agg(F.sum("length"), F.max("sequence_id")).first()
    assert out[0] > 0.97 * 2048 * out[1]


def test_stored_tables_can_be_cleared(spark):
    from pathlib import Path

    from tidemill.llm.common import _own, clear_stored, drop_stored, shared_dir, stored, stored_so_far

    df = stored(spark.range(5), "five")
    path = Path(_own.paths[-1].removeprefix("file://"))
    assert df.count() == 5 and path.is_dir() and str(path).startswith(shared_dir(spark).removeprefix("file://"))
    _own.paths[:] = _own.paths[-1:]
    assert clear_stored(spark) == 1 and not path.exists()
    kept, dropped, last = (stored(spark.range(3), n) for n in ("kept", "dropped", "last"))
    drop_stored(dropped)
    assert _own.paths == [kept.stored_path, last.stored_path] and stored_so_far() == 2
    assert clear_stored(spark, 0, but=last) == 1 and _own.paths == [last.stored_path] and last.count() == 3


def test_shards(spark):
    docs = cases.frame(spark)
    out = shard.assign(docs, F.coalesce("doc_id", F.xxhash64("text")), 5).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(cases.rows()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert not shard.assign(cases.empty(spark), F.col("doc_id")).count()


def test_shards_of_one_key(spark):
    """A key that most rows share fills no window: its cell is ranked in parts, and places stay gapless."""
    rows = spark.range(6_000).select(F.when(F.col("id") % 6 > 0, F.lit(7)).otherwise(F.col("id")).alias("k")).repartition(5)
    out = shard.assign(rows, F.col("k"), 4)
    by = {}
    for r in out.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert [sorted(by[s]) for s in range(4)] == [list(range(1500))] * 4
    placed, _ = shard._parts(rows.select(F.lit(3).alias("_s_cell"), F.monotonically_increasing_id().alias("_s_id")), [3])
    assert max(r["count"] for r in placed.groupBy("_s_cell", "_s_part").count().collect()) < 60


def test_shards_move_little(spark):
    rows = spark.range(20_000)
    place = lambda n: {r["id"]: r["shard"] for r in shard.assign(rows, F.col("id"), n, slack=0.05).collect()}
    a, b = place(16), place(17)
    counts = Counter(a.values())
    assert max(counts.values()) <= 1.05 * 20_000 / 16 + 1
    moved = sum(a[i] != b[i] for i in a)
    assert moved < 2.5 * 20_000 / 17


def test_shard_plan_like_one_by_one():
    """The plan's counts by shard are those of rows that walk the ring one by one, a round at a time."""
    rng = random.Random(3)
    nodes = sorted((rng.randrange(shard.CELLS), s) for s in range(4) for _ in range(3))
    counts = {rng.randrange(shard.CELLS): rng.randint(1, 9) for _ in range(20)}
    total = sum(counts.values())
    bounds = [total // 4 + (s < total % 4) for s in range(4)]
    ranges = shard.plan(counts, nodes, bounds)
    by_cell, by_shard = Counter(), Counter()
    for cell, first, last, s, base in ranges:
        assert base == by_shard[s] and first == by_cell[cell]
        by_cell[cell] += last - first
        by_shard[s] += last - first
    assert by_cell == counts and [by_shard[s] for s in range(4)] == bounds


def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>é" * (i % 50)) for i in range(300)] + [(7, None, None), (None, "u", "h"), (3, "http://x/3", "<p>éé")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(spark):
    own = warc.records(pages(spark))
    back = {(r["page_id"], r["url"], r["html"]) for r in warc.parse(own).collect() if r["digest_ok"]}
    assert back == {(str("" if i is None else i), u or "", h or "") for i, u, h in pages(spark).collect()}
    a = warc.placed(warc.metadata(own), "a", 3)
    for segment in range(3):
        at = 0
        for seq, r in enumerate(a.filter(F.col("segment") == segment).orderBy("seq").collect()):
            assert r["seq"] == seq and r["offset"] == at
            at += r["length"]
    b = a.withColumn("digest", F.when(F.col("seq") % 41 == 5, F.lit("x")).otherwise(F.col("digest"))).filter("segment <> 1 or seq <> 60")
    ta, tb = warc.tree(warc.leaves(a), "ta", 4), warc.tree(warc.leaves(b), "tb", 4)
    assert warc.root(ta) != warc.root(tb) and warc.root(ta) == warc.root(warc.tree(warc.leaves(a), "tc", 4))
    found = {(r["segment"], r["seq"]): r["state"] for r in warc.audit(ta, tb, 4).collect()}
    want = {(r["segment"], r["seq"]): "changed" for r in a.collect() if r["seq"] % 41 == 5}
    assert found == want | {(1, 60): "missing_b"}
    assert not warc.audit(ta, ta, 4).count()
    none = warc.placed(warc.metadata(warc.records(pages(spark).limit(0))), "e")
    assert not none.count() and not warc.audit(warc.tree(warc.leaves(none), "t"), warc.tree(warc.leaves(none), "u")).count()


@pytest.mark.parametrize("segments", [[], [0], [5], [0, 1], [0, 2, 3, 26, 27, 80], list(range(100))])
def test_warc_root_is_a_tree_over_segments(spark, segments):
    nodes = [(s, level, 0, f"h{s}-{level}") for s in segments for level in (0, 1)]
    got = warc.root(spark.createDataFrame(nodes, "segment int, level int, node long, hash string"), 3)
    level = {s: f"h{s}-1" for s in segments}
    most = max(segments, default=0)
    while most:
        up = {}
        for s in sorted(level):
            up.setdefault(s // 3, []).append(f"{s}:{level[s]}")
        level = {s: hashlib.sha256(",".join(c).encode()).hexdigest() for s, c in up.items()}
        most //= 3
    assert got == (level[0] if segments else "")
    assert len(level) <= 1


def test_warc_equal_roots_end_the_audit(spark, monkeypatch):
    a = warc.tree(warc.leaves(warc.placed(warc.metadata(warc.records(pages(spark))), "a", 3)), "ta", 4)
    monkeypatch.setattr(warc, "stored", None)  # nothing is stored, as no level is compared
    assert not warc.audit(a, a, 4).count()


def test_warc_long_bodies_and_other_columns(spark):
    """A very long body is one record; columns named like the operator's own don't matter."""
    rows = [(1, "u", "é<p>" * 2_000_000, 7, "s"), (2, "v", "", 8, "t"), (2, "v", "", 9, "u")]
    own = spark.createDataFrame(rows, "page_id long, url string, html string, segment int, digest string")
    out = warc.placed(warc.metadata(warc.records(own), F.concat("record", F.lit(bytearray(b"x")))), "long", 2).collect()
    for r in out:
        html = "é<p>" * 2_000_000 if r["page_id"] == 1 else ""
        raw = bytes(warc.records(own.filter(F.col("page_id") == r["page_id"])).first()["record"])
        assert r["length"] == len(raw) and r["digest"] == cases.sha(raw) and r["copy_digest"] == cases.sha(raw + b"x") and html.encode() in raw
    assert len(out) == 3


def test_warc_query(spark, sf_dir):
    out = registry.op4_warc_fixity(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    hit = warc.number_of("page_id") % 1000 == 7
    assert out.count() == n and not out.filter(hit != (F.col("state") == "changed")).count()


def test_shard_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.op8_ring_shards(spark, sf_dir).collect():
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "rows"


def test_ids_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for r, ids in zip(docs, library([r["text"] for r in docs]), strict=True):
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in registry.op7_token_ids(spark, sf_dir).collect()) == want


def test_pipeline(spark, sf_dir):
    """Each stage against plain Python over what the one before it kept."""
    import corpus_pipeline
    from tidemill.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf_dir), name))
        assert name == "packing" or kept[-1].columns == columns
    texts = [{r["doc_id"]: r["text"] for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]
    failed = {d for d, t in texts[0].items() for q in [cases.brute_quality(t)] if q[0] < 50 or 100 * q[4] > 50 * q[0]}
    assert not failed & texts[1].keys() and len(texts[1]) > 0.9 * (len(texts[0]) - len(failed)) - 20
    join = cases.brute_join(texts[1])
    assert texts[2].keys() == {d for d, v in join.items() if v[0] == d}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert texts[3].keys() == {d for d, t in texts[2].items() if not cases.brute_contamination(t, items)[4]}
    assert texts[4].keys() == texts[3].keys()
    for d, t in texts[4].items():
        base = cases.brute_secrets(texts[3][d])
        assert ("[" in t) == ("[" in texts[3][d]) or base
        assert all(texts[3][d][a:b] not in t for _, a, b in base)
    pieces = Counter()
    for r in kept[-1].collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {d: len(i) for d, i in zip(texts[4], library(texts[4].values()), strict=True)}
