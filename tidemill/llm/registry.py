"""The registered queries of the numbered operators, over whole tables, and their SQL where SQL can tell."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import binary, decontaminate, divergence, negatives, ngram_join, packing, pivots, quality, secrets, shard, substring, suffix, warc
from tidemill.llm.common import documents, key_back, stored


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that also start elsewhere."""
    out = suffix.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, by the fixed patterns and by the automata that their finds train."""
    docs = documents(spark, sf_dir)
    out = secrets.scan(docs, secrets.train(docs))
    n = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(n(k) for k in secrets.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in two replicas; in the second, one byte of every record whose id's hash is 7
    in 1000 is replaced. A row per record: where it lies, its leaf hash in the first, and what the audit says."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    size = F.octet_length("record")
    flipped = F.concat(F.substring("record", F.lit(1), size - 10), F.lit(bytearray(b"#")), F.substring("record", size - 8, F.lit(9)))
    second = F.when(warc.number_of("page_id") % 1000 == 7, flipped).otherwise(F.col("record"))
    rows = warc.placed(warc.metadata(warc.records(pages), second), "warc", warc.segments_for(pages))
    tree_a, tree_b = warc.tree(warc.leaves(rows), "tree-a"), warc.tree(warc.leaves(rows, "copy_length", "copy_digest"), "tree-b")
    found = warc.audit(tree_a, tree_b)
    leaf = warc.leaves(rows).select("segment", F.col("node").alias("seq"), F.col("hash").alias("leaf"))
    out = rows.join(leaf, ["segment", "seq"]).join(found, ["segment", "seq"], "left")
    return out.select("page_id", "segment", "seq", "offset", "length", "leaf", F.coalesce("state", F.lit("equal")).alias("state"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark windows of 13 words."""
    out = decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, base and verdict of every document."""
    p = quality.P
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    featured = stored(quality.with_features(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "quality")
    model = quality.fit(quality.pattern_counts(featured))
    good = quality.posterior(model)
    return featured.select("doc_id", *(F.col(p + n).alias(n) for n in names), quality.base_failed().alias("base_failed"), (~quality.base_failed() & (good >= 0.5)).alias("kept"), good.alias("posterior"))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and slot; counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    # Rows without an id, and those that share one, fall in different cells by their texts.
    out = shard.assign(rows, F.struct("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to blocks in ascending doc_id order and read back from them."""
    return binary.read_ids(binary.write_ids(documents(spark, sf_dir), tokenizer_path()), with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 20 words that start earlier elsewhere."""
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector, among all."""
    return pivots.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector's positives; every 7th vector's label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, F.col("vec_id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all documents, and the terms that make it."""
    return divergence.audit(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_secrets, op4_warc_fixity, op5_decontaminate, op6_quality, op7_token_ids, op8_ring_shards, op9_substring_dedup, op10_packing, op11_pivot_search, op12_hard_negatives, op13_source_divergence)}

#: Bytes as hex digits, cut into parts of 500 window starts, as taking a substring of a long text counts its characters.
_OP1 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
part AS (SELECT r, n, first, substr(h, 2 * first + 1, 2 * 899) AS p FROM (SELECT r, n, h, unnest(generate_series(0, n - 400, 500)) AS first FROM d WHERE n >= 400)),
w AS (SELECT r, first + j AS i, md5(substr(p, 2 * j + 1, 800)) AS k FROM (SELECT r, first, p, unnest(generate_series(0, least(499, n - 400 - first))) AS j FROM part)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN again USING (k)),
span AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
cut AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start, a AS stop FROM span
  UNION ALL SELECT r, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN span USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS h FROM cut JOIN d USING (r) GROUP BY r),
total AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN total USING (r)"""

_OP5 = r"""WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM split, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, win FROM dw SEMI JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS at FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit JOIN bw USING (n, win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

_OP9 = r"""WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM split WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT pos) AS pos FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM again) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split)
  ANTI JOIN (SELECT doc_id, unnest(pos) AS pos FROM gone) USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)"""

_OP2 = r"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM split WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM sh GROUP BY doc_id),
every AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(digest, '') AS digest FROM split LEFT JOIN sets USING (doc_id)),
reps AS (SELECT digest, min(doc_id) AS rep, min(n) AS n, count(*) AS n_copies FROM every GROUP BY digest),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM reps) AND b.doc_id IN (SELECT rep FROM reps) GROUP BY ALL),
pairs AS (SELECT a, b FROM inter JOIN reps x ON x.rep = a JOIN reps y ON y.rep = b WHERE 5 * n_both >= 4 * (x.n + y.n - n_both)),
link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS other FROM reps UNION SELECT node, b FROM reach JOIN link ON other = a),
root AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
links AS (SELECT a AS node, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies FROM every JOIN reps USING (digest) JOIN root ON root.node = rep LEFT JOIN links ON links.node = rep"""

#: ~ stands for a line end within a literal.
_OP4 = r"""WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, 'WARC/1.1~WARC-Type: resource~WARC-Record-ID: <urn:page:' || page_id || '>~WARC-Target-URI: ' || coalesce(url, '') || '~Content-Type: text/html~WARC-Block-Digest: sha256:'
    || sha256(coalesce(html, '')) || '~Content-Length: ' || strlen(coalesce(html, '')) || '~~' || coalesce(html, '') || '~~' AS record FROM pages),
d AS (SELECT *, sha256(record) AS digest, CAST(strlen(record) AS BIGINT) AS length FROM r),
s AS (SELECT *, CAST(('0x' || substr(md5(page_id || '|' || url || '|' || digest), 1, 8))::BIGINT % (SELECT greatest(256, coalesce(sum(strlen(html)), 0) // 134217728) FROM pages) AS INT) AS segment FROM d),
p AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s WINDOW w AS (PARTITION BY segment ORDER BY page_id, url, length, digest))
SELECT page_id, segment, seq, start AS "offset", length, sha256(seq || ':' || start || ':' || length || ':' || digest) AS leaf,
  CASE WHEN ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8))::BIGINT % 1000 = 7 THEN 'changed' ELSE 'equal' END AS state FROM p"""
_OP4 = _OP4.replace("~", "' || chr(13) || chr(10) || '")

_VECTORS = """v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_OP11 = f"""WITH {_VECTORS},
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

_OP12 = f"""WITH {_VECTORS},
l AS (SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM v WHERE label IS NOT NULL),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score FROM l a JOIN l c ON a.vec_id % 50 = 0 AND a.r <> c.r),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE same QUALIFY nth <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_OP13 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(langs.n), 0) AS in_lang, coalesce(sum(own.n), 0) AS in_group FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN own USING (lang, source) GROUP BY ALL),
every AS (SELECT lang, g.source, term, CAST(1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 1)) // (in_group + v) AS HUGEINT) AS p, CAST(1 + (1000000000::HUGEINT * (kept.n + 1)) // (in_lang + v) AS HUGEINT) AS q, coalesce(own.n, 0) AS n
  FROM groups g JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM every WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES = {"op1_suffix_dedup": _OP1, "op4_warc_fixity": _OP4, "op2_ngram_join": _OP2, "op9_substring_dedup": _OP9, "op5_decontaminate": _OP5, "op11_pivot_search": _OP11, "op12_hard_negatives": _OP12, "op13_source_divergence": _OP13}
