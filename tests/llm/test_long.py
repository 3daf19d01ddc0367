"""Very long texts are taken whole: what crosses the slices inside the operators is found."""

import random

import cases
import numpy as np
import pytest

from tidemill.llm import binary, decontaminate, ngram_join, packing, quality, registry, secrets, substring, suffix


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(11)
    return " ".join("".join(rng.choice("abcdefghiklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(650_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    at = [(1 << 19) - 2_000, 2_000_000 - 3_000, (1 << 20) - 1_000]
    parts = [long_text[a : a + 6_000] for a in at]
    secret = "password=hunter2secret99"
    rows = [(0, long_text), *((i + 1, f"x{i}- {p} -y{i}") for i, p in enumerate(parts)), (9, f"{long_text[:300]} {secret} {long_text}")]
    return spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id < 9"), spark.createDataFrame([(9, rows[-1][1])], "doc_id long, text string"), parts


def test_suffix(docs, long_text):
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs[0]).collect()}
    assert got[0]["n_bytes"] == len(long_text)
    # The excerpts' common ends may reach a byte further by chance of the space around them.
    assert 18_000 <= got[0]["n_removed"] <= 18_012 and got[0]["n_spans"] == 3
    assert all(6_000 <= got[i]["n_removed"] <= 6_004 and got[i]["n_spans"] == 1 for i in (1, 2, 3))


def test_substring(docs, long_text):
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs[0]).collect()}
    assert got[0]["n_words"] == 650_000 and got[0]["n_removed"] == 0 and cases.sha(bytes(got[0]["kept"])) == cases.sha(long_text)
    for i, p in enumerate(docs[2]):
        whole = len(p.split(" "))  # a word cut at either end differs
        assert whole - 2 <= got[i + 1]["n_removed"] <= whole


def test_join_and_quality(docs, long_text):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs[0].unionByName(docs[1])).collect()}
    assert got[0] == got[9] == (0, 1) and got[1] == (1, 0)
    r = quality.with_features(docs[0].filter("doc_id = 0")).select(quality.P + "n_words", quality.P + "n_repeat_words").first()
    assert tuple(r) == (650_000, cases.brute_quality(long_text)[4])


def test_secret_at_its_place(docs, spark):
    text = docs[1].first()["text"]
    spans = secrets.scan(docs[1], secrets.train(docs[1])).first()["base"]
    assert spans == secrets.joined(cases.brute_secrets(text)) and text[int(spans.split(":")[1]) :].startswith("password=hunter2")


def test_contamination(spark, docs, long_text):
    at = len(long_text) // 2
    item = " ".join(long_text[at : at + 400].split(" ")[1:-1])
    bench = spark.createDataFrame([(4, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.report(docs[0], bench).collect()}
    assert got[0] == (650_000, len(item.split(" "))) and got[1][1] == 0


def test_tokens(docs, long_text):
    from test_output import library

    path = registry.tokenizer_path()
    want = library([long_text])[0]
    back = {r["doc_id"]: r["ids"] for r in binary.read_ids(binary.write_ids(docs[0], path)).collect()}
    assert (np.frombuffer(back[0], "<u4") == want).all()
    pieces = packing.pack(docs[0], path).filter("doc_id = 0").groupBy().sum("length").first()[0]
    assert pieces == len(want)


def test_shards(spark, docs, long_text, tmp_path):
    import zlib

    docs[0].write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in registry.op8_ring_shards(spark, str(tmp_path)).collect()}
    assert got[0] == (len(long_text) + 1, zlib.crc32(long_text.encode())) and len(got) == 4
