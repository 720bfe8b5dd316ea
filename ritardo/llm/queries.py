"""Queries of the corpus operators over the given tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ritardo.llm import chat, lang_id, licenses, pieces, pii, resampling, secrets, whitening
from ritardo.llm.common import table
from ritardo.llm.decontamination import contamination
from ritardo.llm.sharding import byte_shards
from ritardo.llm.simhash import near_duplicates
from ritardo.llm.token_counts import count_tokens
from ritardo.llm.top_k import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = (
    f"list_filter(regexp_split_to_array({LOWERED}, "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

OP9_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k,
  array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
dw AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM dp, (SELECT DISTINCT k FROM bw) WHERE s + k - 1 <= len(w)),
m AS (SELECT DISTINCT r, s, k, item_id FROM dw JOIN bw USING (k, t)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m)
  GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""


@query(OP9_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document hit by 13-word windows of the benchmark."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(
        "item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = """
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc
  WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM crc WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
  coalesce(strlen(text), 0) + 8 AS size FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, size - 8), lambda i:
      ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda a, x: xor(a // 256, tab[(xor(a, x) % 256) + 1]))) AS text_crc32
  FROM d, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size
    ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
s AS (SELECT *, (((2 * upto - size) * 24) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INTEGER AS grown_shard FROM s
"""


@query(OP10_SQL)
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near-equal bytes."""
    return byte_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash of 3-word shingles within 2 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, weak ones only beside their complement."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query(licenses.oracle_sql())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the sentences of every document state."""
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"),
        F.array_join("rules", ",").alias("rules"), "n_sentences")


@query(licenses.oracle_sql())
def op4_licenses_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which wrapped notices were found before op4_licenses found them."""
    return op4_licenses(spark, sf_dir)


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary of 50k entries."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


OP8_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query(OP8_SQL)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), 50, 5)


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's checksum is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    d = docs.select("doc_id", "text", lang_id.held_out("doc_id").alias("held_out"))
    return lang_id.predict(d, model).select("doc_id", "held_out", "lang_pred", "score", "fits")


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed patterns, and what a CRF marks besides."""
    docs = table(spark, sf_dir, "documents")
    return pii.scan(docs, pii.train(pii.labelled_table(docs)))


@query()
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document by the 32k model, and whether decoding gives the text back."""
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model,
                        keep_text=False)
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias(
        "n_pieces"), "round_trip")


OP12_SQL = f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc
  WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM crc WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i:
  w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i:
  w[i] || ' ' || w[i + 1]))) AS f FROM b),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
x AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, len(h) // 2), lambda i:
      ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda a, y: xor(a // 256, tab[(xor(a, y) % 256) + 1]))) % 10000 AS k FROM u, tab),
s AS (SELECT k, count(*) AS s FROM df JOIN x USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN x USING (f) GROUP BY k),
al AS (SELECT (SELECT count(*) FROM df) AS sa, (SELECT count(*) FROM bf) AS ta),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sa + 10000.0::DOUBLE) / (
  (coalesce(s, 0) + 1.0::DOUBLE) * (ta + 10000.0::DOUBLE))))::BIGINT AS g
  FROM s FULL JOIN t USING (k), al),
m AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM df JOIN x USING (f) JOIN g USING (k) GROUP BY r),
z AS (SELECT doc_id, len(w) AS nw, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (r)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
  AS score FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY nw >= 20 ORDER BY score DESC, doc_id NULLS LAST)
  AS place, count(*) FILTER (nw >= 20) OVER () AS able FROM c)
SELECT doc_id, n_features, weight, score,
  CASE WHEN nw >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM o
"""


@query(OP12_SQL)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by likeness to the benchmark texts."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(
        spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the 16 widest directions of the embeddings, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


@query(chat.oracle_sql())
def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted by a compiled template, and read back from what it wrote."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(own), chat.TEMPLATE))
