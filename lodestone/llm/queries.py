"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    coded = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, pos, txt[pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS txt FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(txt) + 1)) AS pos) p),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS lost
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op7_exact_top_k"] = r"""
WITH item AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
  FROM item q JOIN item c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return found.select("row.doc_id", (F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")


#: Bytes of text that a shard may hold: small, so that the directory is split on small tables too.
SHARD_BYTES = 256 << 10


@_query
def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    found = assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select("row.doc_id", "shard", F.col("depth").cast("int").alias("depth"), "n_bytes", "shard_bytes")


ORACLES["op8_extendible_sharding"] = rf"""
WITH doc AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h
  FROM documents),
tried AS (SELECT doc.*, d, h >> (48 - d) AS prefix FROM doc, (SELECT unnest(range(0, 49)) AS d) depths),
bucket AS (
  SELECT d, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n FROM tried GROUP BY d, prefix),
fits AS (
  SELECT doc_id, n_bytes, tried.d, tried.prefix, shard_bytes,
         row_number() OVER (PARTITION BY doc_id ORDER BY tried.d) AS r
  FROM tried JOIN bucket ON tried.d = bucket.d AND tried.prefix = bucket.prefix
  WHERE shard_bytes <= {SHARD_BYTES} OR n = 1)
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), d::INTEGER) END AS shard,
       d::INTEGER AS depth, n_bytes, shard_bytes
FROM fits WHERE r = 1
"""


@_query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    learns = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    found = score_texts(_table(spark, sf_dir, "documents"), learns)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], is_altered=tampered, altered={"text": lowered}, with_proof=False)
    return found.drop("proof")


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, text,
         list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
leaf AS (
  SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':'
           || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM told),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf),
node(g, level, pos, h, n) AS (
  SELECT g, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
  FROM node WHERE n > 1 GROUP BY g, level, pos // 16, n),
subroot AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
crown(level, pos, h, n) AS (
  SELECT 0, pos, h, n FROM subroot
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM crown WHERE n > 1 GROUP BY level, pos // 16, n),
run AS (
  SELECT g, level, pos // 16 AS run, list(h ORDER BY pos) AS kids FROM node WHERE n > 1 GROUP BY g, level, pos // 16
  UNION ALL
  SELECT NULL, level, pos // 16, list(h ORDER BY pos) FROM crown WHERE n > 1 GROUP BY level, pos // 16),
climb(id, g, level, pos, fold, proof) AS (
  SELECT row_number() OVER (), g, 0, pos, coalesce(changed, leaf), '' FROM placed
  UNION ALL
  SELECT c.id, coalesce(c.g, ''), c.level + 1, c.pos // 16,
         sha256(list_aggregate(list_transform(kids, lambda k, i: CASE WHEN i = c.pos % 16 + 1 THEN c.fold ELSE k END), 'string_agg', '')),
         c.proof || coalesce(list_aggregate(list_filter(kids, lambda k, i: i <> c.pos % 16 + 1), 'string_agg', ''), '')
  FROM climb c JOIN run r ON r.g = c.g AND r.level = c.level AND r.run = c.pos // 16),
lower_end AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
upper(id, level, pos, fold, proof) AS (
  SELECT e.id, 0, s.pos, e.fold, e.proof FROM lower_end e JOIN subroot s ON s.g = e.g
  UNION ALL
  SELECT c.id, c.level + 1, c.pos // 16,
         sha256(list_aggregate(list_transform(kids, lambda k, i: CASE WHEN i = c.pos % 16 + 1 THEN c.fold ELSE k END), 'string_agg', '')),
         c.proof || coalesce(list_aggregate(list_filter(kids, lambda k, i: i <> c.pos % 16 + 1), 'string_agg', ''), '')
  FROM upper c JOIN run r ON r.g IS NULL AND r.level = c.level AND r.run = c.pos // 16),
upper_end AS (SELECT * FROM upper QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
numbered AS (SELECT *, row_number() OVER () AS id FROM placed),
top AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = root AS verified
FROM numbered p JOIN upper_end u ON u.id = p.id JOIN subroot s ON s.g = p.g CROSS JOIN top
"""


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


#: What both turns of conversation -7 say: control strings and an escape.
ODD = "\\### Assistant: </turn> ok"


@_query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    odd = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.to_variant_object(F.struct(F.lit(ODD).alias("prompt"), F.lit(ODD).alias("response"))).alias("record")
    )
    turns = chat.canonical(rows.unionByName(odd), F.col("conv_id"), F.col("record"), F.col("turn"))
    whole = chat.assemble(chat.render(turns))
    read = whole.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLES["op13_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
piece AS (
  SELECT *, '<turn>' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '</\turn>'), '<turn>', '<\turn>'), chr(10), '<\line>') || chr(10)
         || replace(replace(replace(text, '\', '\\'), '</turn>', '</\turn>'), '<turn>', '<\turn>') || '</turn>' || chr(10) AS piece
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(piece))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(piece)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM piece GROUP BY conv_id
"""
