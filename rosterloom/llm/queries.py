"""One registered query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    chat,
    languages,
    lm,
    mixing,
    packing,
    ranking,
    secrets,
    superminhash,
    tiles,
    topk,
    toxicity,
    trie,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@_query("op1_superminhash", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * c >= 80 * (s.n + t.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN sides b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id""")
def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on 2-word shingles."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), n=2)


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).withColumn("toxic", F.col("toxic").cast("int"))


@_query("op6_pairwise_quality")
def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return ranking.quality_scores(docs, ranking.train(docs, table(spark, sf_dir, "labels")))


@_query("op4_weighted_mixture", r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5('11:' || doc_id), 1, 13))::BIGINT + 0.5) / 16 ** 13) / greatest(1e-6,
      coalesce(length(regexp_replace(text, '[^\p{L}\t-\r ]+', '', 'g')) / greatest(1, length(text)),
        0)) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS n,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT 0 AS i, (SELECT sum(n) / sum(w) FROM sources) AS level
  UNION ALL
  SELECT i + 1, (SELECT (sum(n) - coalesce(sum(3 * n) FILTER (3 * n < level * w), 0))
      / sum(w) FILTER (3 * n >= level * w) FROM sources)
  FROM levels WHERE i < 40),
goals AS (SELECT source, n, least(3 * n, w * (SELECT max(level) FROM levels)) AS target FROM sources),
placed AS (
  SELECT s.*, g.n, g.target, floor(target / nullif(g.n, 0)) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target,
  (size * coalesce(epochs + (before + size / 2 < target - epochs * n)::INT, 0))::BIGINT AS taken
FROM placed""")
def op4_weighted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of all sources by the weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixture(docs, mixing.words_in("text"), mixing.letters_share("text")).select(
        "doc_id", "size", "source_size", "target", "taken")


@_query("op8_best_two_fit")
def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


@_query("op2_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + 2 * len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>'))
    + length(role) + length('<|im_start|>') + length('<|im_end|>') + 2 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted texts."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                 "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turn_rows(turns.unionByName(more)))


@_query("op5_cross_entropy_difference")
def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses under models of the good documents and of all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@_query("op7_threshold_top_k", """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.no <> c.no)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY no ORDER BY score DESC, vec_id)
QUALIFY rank <= 5""")
def op7_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op9_pca_tiles", """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
v AS (
  SELECT no, label, e FROM d WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.no AS x, b.no AS y FROM v a JOIN v b ON a.label = b.label AND a.no <> b.no
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT no AS x, no AS y FROM d
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT r.x, min(d.vec_id) AS component_id FROM reach r JOIN d ON d.no = r.y GROUP BY r.x)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, d.vec_id = r.component_id AS kept
FROM d JOIN least r ON r.x = d.no
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = d.no""")
def op9_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with cosine 0.98 or more."""
    return tiles.near_vectors(table(spark, sf_dir, "embeddings"))


@_query("op10_randomness_battery")
def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


@_query("op11_prefix_trie", """
WITH said AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, id, strlen(text) AS size, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM said),
crcs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(
      range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)),
    4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM said)),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, h, least(h, coalesce(b.n, 0)) AS head
  FROM crcs c LEFT JOIN (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id) b
  ON b.conv_id = c.conv_id - c.conv_id % 5),
rebuilt AS (
  SELECT conv_id, head + pos - h AS pos, id, size FROM placed JOIN convs USING (conv_id) WHERE pos > h
  UNION ALL SELECT c.conv_id, p.pos, p.id, p.size
  FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.head),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS k, 0 AS size FROM convs UNION ALL
  SELECT conv_id, pos, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY pos)), size
  FROM rebuilt),
deepest AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
members AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size
  FROM paths GROUP BY depth, k),
ups AS (SELECT DISTINCT b.k, a.k AS up FROM paths a JOIN paths b
  ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
kids AS (SELECT up AS k, count(*) AS n FROM ups GROUP BY up),
pairs AS (SELECT DISTINCT a.k, b.k AS low FROM paths a JOIN paths b
  ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT p.k, sum((m.n - 1) * m.size) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM pairs p JOIN members m ON m.k = p.low LEFT JOIN kids c ON c.k = p.low GROUP BY p.k),
ends AS (
  SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM paths JOIN deepest USING (conv_id, depth) GROUP BY k)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs,
  coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM members m JOIN sums s ON s.k = m.k LEFT JOIN ups ON ups.k = m.k LEFT JOIN members u ON u.k = ups.up
LEFT JOIN kids c ON c.k = m.k LEFT JOIN ends e ON e.k = m.k""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations, heads exchanged in groups of five."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers' tokens in every document."""
    return alignment.align(table(spark, sf_dir, "documents"))


@_query("op13_language_spans")
def op13_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return languages.predicted(docs, languages.train(docs))
