"""The divergence audit against counting in plain Python."""

from collections import Counter
import random
import re

import numpy as np
import pytest

from tidemill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n int, docs int, term string, `all` int, first int, p int, q int, nth int, none int, cell int, rank int"
WHOLE = 10**9


def brute(docs, least=3, ranks=200):
    """docs: text, lang, source."""
    split = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in split}:
        inside = Counter(t for own, _, w in split if own == lang for t in set(w))
        kept = [t for t, n in inside.items() if n >= least]
        count = {s: Counter() for own, s, _ in split if own == lang}
        for own, s, w in split:
            if own == lang:
                count[s].update(t for t in w if inside[t] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + WHOLE * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in p:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1)]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Zebra", "é", "日本語", "abcdefgh", "abcdefghi", "sixteenletterslo", "seventeenletterss", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ñ" * 8, "ñ" * 9, "x" * 3000, "🙂🙂"]
    vocabulary += ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 20))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((20, 134))]) + rng.choice(("", ".", "1", "\0", "-x")) for _ in range(n))
    docs = [(text(rng.randint(0, 60)), rng.choice(("en", "de")), rng.choice(("s0", "s0", "s1", "é", None, ""))) for _ in range(60)]
    docs += [(None, "en", "silent"), ("", None, None), ("123 !?", "en", "no words"), ("rare words only here", "xx", "a"), ("others", "xx", "b"), ("lone", "yy", "z"), (text(30_000), "de", "long")]
    return docs + docs[:5]


@pytest.mark.parametrize(("seed", "sources", "dense"), [(0, 256, 1 << 21), (1, 2, 40)])
def test_audit(spark, monkeypatch, seed, sources, dense):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "STRETCH", 3000)
    docs = rows(seed)
    df = spark.createDataFrame([(i, *d, *[1, 2, "t", *[3] * 8]) for i, d in enumerate(docs)], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == brute(docs) and len(got) > 100


def test_ranks_end_where_asked_for(spark):
    docs = rows(2)
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df, 2, 7).collect()) == brute(docs, 2, 7)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digits_sort_stably():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) >> rng.integers(0, 63, 5000, dtype=np.uint64)
    assert (divergence.by_digits(np.arange(5000), keys) == np.argsort(keys, kind="stable")).all()


def test_counts_of_a_stretch():
    texts = ["Ab ab abcdefghij x" + "y" * 20, "ab", "", "AB cd " + "x" + "y" * 20]
    got = divergence._counted([("en", "s"), ("en", "t")], [0, 1, 1, 0], [t.encode() for t in texts]).to_pylist()
    want = {("s", "ab"): (3, 2), ("s", "abcdefghij"): (1, 1), ("s", "x" + "y" * 20): (2, 2), ("s", "cd"): (1, 1), ("t", "ab"): (1, 1)}
    assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in got} == want and len(got) == len(want)
