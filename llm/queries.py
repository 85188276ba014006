"""The package's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    bm25, bpe, decontamination, importance, language_id, ngram_join, quality, quotation, sampling, secret_scan, substring_dedup, token_counts, vector_codes, warc,
)

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of lower-case 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), n=4, percent=85, lower=True)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), e AS (
  SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS k FROM s GROUP BY doc_id
), k AS (
  SELECT k, count(*) AS n_copies FROM e GROUP BY k
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id))::BIGINT AS component_id,
  coalesce(k.n_copies, 1)::BIGINT AS n_copies
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN k USING (k)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; ``over_limit``: more than 512 tokens."""
    docs = table(spark, sf_dir, "documents")
    out = token_counts.token_counts(docs, public_tokenizers.path(BYTE_BPE))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, one row per document and item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, deduplicated by payload digest, and read back."""
    return warc.resolve_revisits(table(spark, sf_dir, "pages"))


_HEX = ", ".join(f"('0x' || substr(h, {5 * k + 1}, 5))::INT" for k in range(8))
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, html, h, array_to_string(list_transform(flatten(list_transform([{_HEX}], lambda v: [v >> 15, (v >> 10) & 31, (v >> 5) & 31, v & 31])),
    lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v + 1)::BIGINT, 1)), '') AS b FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", sampling.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without 50-word windows that start in an earlier one."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50)
), o AS (
  SELECT k, min(doc_id) AS owner FROM w GROUP BY k
), g AS (
  SELECT doc_id, list(DISTINCT i) AS gone
  FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM w JOIN o USING (k) WHERE owner < doc_id) GROUP BY doc_id
), r AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, ws, g.gone FROM d LEFT JOIN g USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM r) AS u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS i FROM g) AS x WHERE x.doc_id = u.doc_id AND x.i = u.i)
  GROUP BY doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM r LEFT JOIN kept USING (doc_id)
"""


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents")
    out = bpe.encode_decode(docs, public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op8_chat_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its place in reply order and its text without quotations."""
    return quotation.reply_order(table(spark, sf_dir, "conversations"))


def quoting_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies between messages that quote: of three turns the second quotes the first, the third quotes both, nested.

    The given conversations quote nothing, so each message gets the quoted form of the
    turns before it in front of its own text; all messages are in.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = lambda k: c.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"text_{k}"))
    quote = lambda marks, text: F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks)))
    one, two = quote("> ", F.col("text_1")), quote(">> ", F.col("text_2"))
    front = F.when(F.col("turn") % 3 == 1, one).when(F.col("turn") % 3 == 2, F.concat_ws("\n", two, one))
    quoting = c.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    quoting = quoting.withColumn("text", F.when(F.col("text_1").isNotNull() & front.isNotNull(), F.concat(front, F.lit("\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    return quotation.reply_order(quoting.drop("text_1", "text_2")).select("conv_id", "turn", "reply_to", "depth")


QUOTING_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations
), p AS (
  SELECT a.conv_id, a.turn, min(o.turn) AS reply_to
  FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 JOIN c o ON o.conv_id = b.conv_id AND o.t = b.t
  WHERE a.turn % 3 IN (1, 2) AND regexp_matches(b.t, '[\p{L}\p{N}]') GROUP BY ALL
), l AS (
  SELECT c.conv_id, c.turn, p.reply_to FROM c LEFT JOIN p USING (conv_id, turn)
), r AS (
  SELECT conv_id, turn, reply_to, 0 AS depth FROM l WHERE reply_to IS NULL
  UNION ALL SELECT l.conv_id, l.turn, l.reply_to, r.depth + 1 FROM l JOIN r ON l.conv_id = r.conv_id AND l.reply_to = r.turn
)
SELECT conv_id, turn, reply_to, depth::INT AS depth FROM r
"""


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter(F.col("doc_id") % 50 == 0))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), p AS (
  SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY ALL
), g AS (
  SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d
), i AS (
  SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, g GROUP BY word, n
), s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))), 6) AS score
  FROM (SELECT doc_id, word FROM p WHERE doc_id % 50 = 0) q JOIN p USING (word) JOIN i USING (word) JOIN d ON d.doc_id = p.doc_id, g
  GROUP BY ALL
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s
)
SELECT query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows outside the held-out fold."""
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight toward the benchmark's words, and the draw of a tenth of those with 20 words or more."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), q AS (
  SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w
  FROM benchmark
), o AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL
), h AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS k
  FROM (SELECT w FROM o UNION SELECT w FROM q), crc
), s AS (
  SELECT k, sum(n) AS n FROM o JOIN h USING (w) GROUP BY k
), t AS (
  SELECT k, count(*) AS n FROM q JOIN h USING (w) GROUP BY k
), g AS (
  SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT k FROM h) LEFT JOIN s USING (k) LEFT JOIN t USING (k)
), m AS (
  SELECT doc_id, sum(n * gain) AS total FROM o JOIN h USING (w) JOIN g USING (k) GROUP BY doc_id
), r AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total::DOUBLE / len(ws)) END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM d LEFT JOIN m USING (doc_id)
), x AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM r WHERE n_features >= 20) THEN place END AS rank FROM x
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: fixed patterns, and stretches of high entropy that the allow-list doesn't explain."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.FIXED))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in secret_scan.FIXED), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's product code: 16 parts, 64 entries each, two rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0]


def _assigned(entries: str) -> str:
    """SQL: each part's nearest entry (its distance times 64 plus the entry, at the least)."""
    return f"SELECT vec_id, j, x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS de FROM p JOIN {entries} USING (j) GROUP BY vec_id, j, x"


def _means(assigned: str, entries: str) -> str:
    """SQL: entries after a round."""
    return f"""SELECT j, e, coalesce(m.c, o.c) AS c FROM {entries} o LEFT JOIN (
  SELECT j, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT j, de % 64 AS e, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM {assigned}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL) GROUP BY ALL) m USING (j, e)"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, j, v[j * (len(v) // 16) + 1 : (j + 1) * (len(v) // 16)] AS x FROM k, (SELECT unnest(range(16)) AS j)
), c0 AS MATERIALIZED (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)
), a1 AS MATERIALIZED ({_assigned("c0")}), c1 AS MATERIALIZED ({_means("a1", "c0")}
), a2 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_means("a2", "c1")}
), a3 AS MATERIALIZED ({_assigned("c2")}), r AS (
  SELECT vec_id, string_agg(printf('%02x', de % 64), '' ORDER BY j) AS code, sum(de // 64)::BIGINT AS error FROM a3 GROUP BY vec_id
), s AS (
  SELECT vec_id, label, code, error FROM r JOIN k USING (vec_id)
)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM c2) AS codebooks_sha256 FROM s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_chat_quotation": op8_chat_quotation,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_secret_scan": op12_secret_scan,
    "op13_vector_codes": op13_vector_codes,
    "quoting_turns": quoting_turns,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op4_warc_revisits": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op9_exact_top_k": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
    "quoting_turns": QUOTING_SQL,
}
