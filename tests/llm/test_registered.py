"""The registered queries against plain Python, and on tables that are empty or odd in every way."""

from bisect import bisect_left
from collections import Counter
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_output import library

import corpus_pipeline
from tidemill.llm import registry, shard

QUERIES = registry.QUERIES | corpus_pipeline.QUERIES


def test_suffix_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = registry.op1_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = cases.brute_suffix(docs, 400)
    assert sorted(map(tuple, got)) == sorted(want) and any(w[2] for w in want)


def test_shard_query_walks_the_ring(spark, sf_dir):
    """Each row by itself: cells in order offer their rows to the next shard clockwise, then to the one after, until all have a place."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    key = F.struct("doc_id", F.crc32(text).alias("text_crc32"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64(key).alias("h")).collect()
    nodes = shard.ring(spark, 16, 256)
    places, waiting = [c for c, _ in nodes], {}
    for h, d in sorted((r["h"], r["doc_id"]) for r in rows):
        waiting.setdefault((h % (1 << 64)) >> 48, []).append(d)
    bound = [len(rows) // 16 + (s < len(rows) % 16) for s in range(16)]
    full, want = [[] for _ in range(16)], {}
    for turn in range(16):
        for cell in sorted(waiting):
            at = bisect_left(places, cell) % len(nodes)
            clockwise = list(dict.fromkeys(s for _, s in nodes[at:] + nodes[:at]))
            own = full[s := clockwise[turn]]
            while waiting[cell] and len(own) < bound[s]:
                want[waiting[cell][0]] = (s, len(own))
                own.append(waiting[cell].pop(0))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in registry.op8_ring_shards(spark, sf_dir).collect()}
    assert got == want and len(want) == len(rows)


def test_packing_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = dict(zip(docs, library(docs.values()), strict=True))
    covered, filled = Counter(), {}
    for r in registry.op10_packing(spark, sf_dir).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {d: len(i) for d, i in ids.items()} and sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


DOCS = "doc_id long, text string, lang string, source string, n_chars long, sub long, segment int, w string, len int, seed long, spans string, stored_path string"


GOOD = " ".join(f"word{i} and" for i in range(60))
ODD = [(1, None), (2, ""), (None, None), (None, ""), (3, "one"), (3, "one"), (4, GOOD), (4, GOOD), (4, GOOD + " token=abcdef99"), (None, GOOD), (5, " \t\n"), (6, "\0 \x1c"), (7, "password=hunter2 " + GOOD)]


def worked_out(name: str) -> tuple[list[str], list[tuple]] | None:
    """Columns of the query and their values over ``ODD``, worked out in plain Python row by row."""
    crc = lambda t: zlib.crc32((t or "").encode())
    if name.startswith("op1_"):
        return ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], cases.brute_suffix(ODD, 400)
    if name.startswith("op3_"):
        found = [(d, cases.brute_secrets(t)) for d, t in ODD]
        return ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], [(d, *(sum(s[0] == k for s in b) for k in ("assign", "access", "hex")), cases.sha(",".join(f"{k}:{a}:{z}" for k, a, z in b))) for d, b in found]
    if name.startswith("op5_"):
        items = {1: "", 2: "one", None: "word1 and word2"}
        own = lambda t: [(i, x) for i, x in items.items() if cases.brute_contamination(t, {i: x})[2]]
        return ["doc_id", "n_words", "n_hit", "contaminated"], [(d, *(r := cases.brute_contamination(t, dict(own(t))))[:2], r[4]) for d, t in ODD]
    if name.startswith("op6_"):
        made = [(d, cases.brute_quality(t)) for d, t in ODD]
        return ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], [(d, *q, bad := q[0] < 50 or 2 * q[4] > q[0], not bad) for d, q in made]
    if name.startswith("op7_"):
        ids = [(d, i) for (d, t), i in zip(ODD, library([t for _, t in ODD]), strict=True)]
        return ["doc_id", "n_tokens", "ids_crc32"], [(d, len(i), zlib.crc32(i.tobytes())) for d, i in ids]
    if name.startswith("op8_"):
        return ["doc_id", "size", "text_crc32"], [(d, len((t or "").encode()) + 1, crc(t)) for d, t in ODD]
    if name.startswith("op9_"):  # in order of ids, the rows of one text that share an id being one document; whole texts repeat
        seen, out = set(), []
        for d, t in sorted(set(ODD), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""))):
            w = cases.words(t)
            wins = [tuple(w[i : i + 20]) for i in range(len(w) - 19)]
            gone = {j for i, x in enumerate(wins) if x in seen for j in range(i, i + 20)}
            seen |= set(wins)
            out += [(d, len(w), len(gone), cases.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] * ODD.count((d, t))
        return ["doc_id", "n_words", "n_removed", "kept_sha256"], out
    return None


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with empty tables, and with tables of nulls, empty texts, repeated rows and columns named like the operators' own."""
    docs = [(i, t, *[None] * 3, 9, 1, "w", 2, 3, "s", "p") for i, t in ODD]
    odd_pages = [(None, None, None), (1, None, "x"), (1, None, "x"), (2, "u", ""), (None, "u", "h" * 100_000)]
    items = [(None, None), (1, ""), (2, "one"), (None, "word1 and word2"), (2, "one")]
    vecs = [(None, [1.0], 1), (0, None, 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, [1.0, None], 1), (50, [float("nan")], 1), (50, [], None), (7, [0.5], 9), (3, [0.25, 3.0], 0), (4, [1.0, 1.0], 2)]
    out = {}
    for name, keep in (("empty", 0), ("odd", None)):
        path = str(tmp_path_factory.mktemp(name))
        for table, rows, schema in (("documents", docs, DOCS), ("pages", odd_pages, "page_id long, url string, html string"), ("benchmark", items, "item_id long, text string"), ("embeddings", vecs, "vec_id long, embedding array<float>, label int")):
            spark.createDataFrame(rows[:keep], schema).write.parquet(f"{path}/{table}.parquet")
        out[name] = path
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, tables, name):
    rows = QUERIES[name](spark, tables["odd"]).collect()
    if name == "pipeline":  # one row of the good text stays, and its near duplicate with a secret has gone with the copies
        assert {r["doc_id"] for r in rows} <= {None, 4, 7} and rows
    elif name == "op11_pivot_search":
        assert sorted(tuple(r) for r in rows if r["query_id"] == 50) == [(50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 3, 0), (50, 4, 4, 0), (50, 5, 7, 0)]
        assert sorted(tuple(r) for r in rows if r["query_id"] == 0) == sorted(2 * [(0, 1, 3, 409600), (0, 2, 0, 327680), (0, 3, 4, 196608), (0, 4, 7, 32768), (0, 5, 50, 0)])
    elif name == "op12_hard_negatives":  # the label of 0 becomes 2: its positives are its copy and 4, and no other score lies in their windows
        assert rows == []
    elif name == "op13_source_divergence":  # one group of empty names: no other source
        assert rows == []
    else:
        assert len(rows) == (5 if name == "op4_warc_fixity" else 13)
    if want := worked_out(name):
        assert sorted((tuple(r[c] for c in want[0]) for r in rows), key=str) == sorted(want[1], key=str)
    elif name == "op2_ngram_join":  # three near copies of one text, by id and text; and texts without words
        got = sorted(((r["doc_id"], r["n_links"], r["n_copies"]) for r in rows), key=str)
        assert [g for g in got if g[0] in (4, 7)] == [(4, 2, 1), (4, 2, 2), (4, 2, 2), (7, 2, 1)]
        assert {g[2] for g in got if g[0] == 3} == {1}
    elif name == "op10_packing":  # far fewer ids than a window holds: one sequence, every document whole in it
        ids = library([t for _, t in ODD])
        assert {r["sequence_id"] for r in rows} == {0} and sorted((r["doc_id"] is None, r["doc_id"] or 0, r["length"], r["ids_crc32"]) for r in rows) == sorted((d is None, d or 0, len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(ODD, ids, strict=True))
    elif name == "op4_warc_fixity":
        assert Counter(r["page_id"] for r in rows) == {None: 2, 1: 2, 2: 1} and all(r["length"] > 0 for r in rows)


def test_pipeline_keeps_one_row_of_copies(spark, tables):
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, tables["odd"])
    assert kept.columns == docs.columns and kept.count() == 5
    one = corpus_pipeline.near_duplicate_stage(spark, kept, tables["odd"])
    assert one.columns == docs.columns and one.count() == 1
    masked = corpus_pipeline.secrets_stage(spark, kept, tables["odd"])
    assert sorted(r["text"].count("[assign]") for r in masked.collect()) == [0, 0, 0, 1, 1]


def test_run_clears_what_stages_stored(spark, tables):
    from tidemill.llm.common import stored_so_far

    before = stored_so_far()
    assert corpus_pipeline.run(spark, tables["odd"]).count()
    # The last stage's input, and what packing itself reads, are left.
    assert stored_so_far() - before <= 3


def test_a_thread_clears_its_own_tables_only(spark):
    from threading import Thread

    from tidemill.llm.common import clear_stored, stored, stored_so_far

    begun, other = stored_so_far(), []
    work = Thread(target=lambda: other.append(stored(spark.range(3), "other")))
    work.start()
    work.join()
    mine = stored(spark.range(5), "mine")
    assert stored_so_far() == begun + 1 and clear_stored(spark, begun, but=mine) == 0
    assert clear_stored(spark, begun) == 1 and other[0].count() == 3


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemill.llm.common import shared_dir

    unset = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://x:7077")))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local-cluster[3,2,1000]")))
    local = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]"))
    assert shared_dir(local) == shared_dir(local)
