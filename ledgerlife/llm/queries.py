"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlife.llm import byte_bpe, hamming_search, hard_negatives, language_id, license_scan, line_quality, mixing, prefix_trie, secret_scan, simhash, token_store, toxicity, wrappers
from ledgerlife.llm.common import new_path, stored, table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
DIMS = 64


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document, lines judged over all documents of its source."""
    return line_quality.judge(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op3_hamming_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest sign codes of every 50th vector among all vectors."""
    vectors = table(spark, folder, "embeddings")
    codes = stored(hamming_search.sign_codes(vectors, "embedding", dims=DIMS).select(F.col("vec_id").alias("id"), "code"), "signs")
    return hamming_search.top_k(codes, codes.filter("id % 50 = 0"), DIMS, 10)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of each document."""
    plan = mixing.plan(table(spark, folder, "documents"))
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, decoded="decoded")
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = wrappers.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Write the ids of all documents as a store and read every one back through its key index."""
    path = new_path(spark, "store")
    token_store.write(table(spark, folder, "documents"), path, token_store.word_encoder(WORD_BPE, END_ID))
    found = token_store.read(spark, path)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document from its text and its source's prior."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    model = language_id.fit(docs)
    found = language_id.identify(docs.drop("lang"), model, host_col="source", keep_text=False)
    return found.select("doc_id", "language", F.round("probability", 6).alias("probability"), F.col("recognised").alias("kept"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out quarter."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        *(secret_scan.counted(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.joined(kinds=("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined().alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Base places, labels and score of every document."""
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    starts = F.transform(F.filter("detections", lambda d: d["base"]), lambda d: d["start"])
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        license_scan.labels(base_only=True).alias("base_labels"), license_scan.labels().alias("labels"), "score",
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every 100th vector among all vectors, every 7th of which has the next label."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # A component that isn't finite becomes null, and its row takes no part.
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double")).cast("long"))
    rows = vectors.select("vec_id", F.transform("embedding", finite).alias("embedding"), label.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    q.__name__: q
    for q in (
        op1_simhash, op2_line_quality, op3_hamming_search, op4_mixing, op5_byte_bpe, op6_wrappers, op7_token_store, op8_language_id, op9_toxicity,
        op10_secret_scan, op11_prefix_trie, op12_license_scan, op13_hard_negatives,
    )
}

ORACLES = {
    "op2_line_quality": line_quality.ORACLE,
    "op4_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM sums),
weighed AS (
  SELECT source, source_size, 2.0 * source_size AS cap,
    CAST(CASE turn % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM turns),
total AS (SELECT 1.5 * sum(source_size) AS words FROM sums),
points AS (SELECT cap / weight AS level FROM weighed UNION SELECT 0.0),
filled AS (
  SELECT p.level, sum(least(w.cap, p.level * w.weight)) AS words,
    sum(CASE WHEN w.cap / w.weight <= p.level THEN w.cap ELSE 0 END) AS full_words,
    sum(CASE WHEN w.cap / w.weight > p.level THEN w.weight ELSE 0 END) AS open_weight
  FROM points p, weighed w GROUP BY p.level),
water AS (
  SELECT (t.words - f.full_words) / nullif(f.open_weight, 0) AS level
  FROM filled f, total t WHERE f.words <= t.words ORDER BY f.level DESC LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight OR level IS NULL THEN cap ELSE weight * level END AS target
  FROM weighed, water),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.rank, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget - (budget // source_size) * source_size - ahead)) END AS BIGINT) AS taken
FROM placed""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, count(*) AS n FROM own GROUP BY c),
heads AS (
  SELECT c, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))),
    4294967295::BIGINT) % 6 AS h
  FROM lengths),
given AS (SELECT h.c, h.h, h.c - h.c % 100 AS donor, least(h.h, coalesce(l.n, 0)) AS k FROM heads h LEFT JOIN lengths l ON l.c = h.c - h.c % 100),
turns AS (
  SELECT o.c, o.p - g.h + g.k AS p, o.r, o.t FROM own o JOIN given g ON o.c = g.c WHERE o.p >= g.h
  UNION ALL SELECT g.c, o.p, o.r, o.t FROM given g JOIN own o ON o.c = g.donor WHERE o.p < g.k),
prefixes AS (
  SELECT c, p + 1 AS d, length(t) AS ch, string_agg(md5(length(r) || ':' || r || t), '') OVER (PARTITION BY c ORDER BY p) AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM given),
nodes AS (SELECT path, d, min(c) AS conv, count(*) AS n, any_value(ch) AS ch FROM prefixes GROUP BY path, d),
children AS (SELECT left(path, CAST(32 * (d - 1) AS BIGINT)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
ends AS (
  SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS hash
  FROM (SELECT c, arg_max(path, d) AS path FROM prefixes GROUP BY c) GROUP BY path),
sums AS (
  SELECT a.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((w.n - 1) * w.ch) AS saved
  FROM nodes w LEFT JOIN children k ON k.path = w.path JOIN prefixes a ON a.c = w.conv AND a.d <= w.d GROUP BY a.path)
SELECT n.conv AS conv_id, CAST(n.d AS BIGINT) AS depth, up.conv AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.hash, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.path = left(n.path, CAST(32 * (n.d - 1) AS BIGINT))""",
    "op13_hard_negatives": r"""
WITH held AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM held a JOIN held b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT a, b AS positive_id, s AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.positive_id ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 80 * p.positive_score <= 100 * n.s AND 100 * n.s <= 100 * p.positive_score
QUALIFY rank <= 5""",
}
