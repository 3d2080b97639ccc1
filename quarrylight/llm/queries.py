"""The registered queries of the subpackage and, where SQL can express one, the SQL it is compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import (
    collocations, covertree, dac, decontam, langid, negatives, packing, passages, secret_scan, simhash, templates,
    token_counts, toxicity,
)
from quarrylight.llm.common import crc_of_id
from quarrylight.session import new_folder
from quarrylight.sources.tables import read_table


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.remove_repeated(read_table(spark, folder, "documents"))


def byte_level() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"), size=3, radius=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(read_table(spark, folder, "pages"))


def op2_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(read_table(spark, folder, "embeddings"), threshold=0.95)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, folder, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.joined(secret_scan.every()).alias("spans"),
    )


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    held_out = (crc_of_id() % 5) == 0
    labels = read_table(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(~held_out), labels.filter(~held_out), docs)
    return toxicity.rate(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("passages", lambda x: F.struct(x["begin"], x["end"])).alias("passages"),
    )


def op7_binary(spark: SparkSession, folder: str) -> DataFrame:
    """The files are written in the shared folder and read back; ids are checked by their crc32."""
    place = new_folder(spark, "ids")
    dac.write(read_table(spark, folder, "documents"), place, byte_level(), end_id=0)
    return dac.read(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = (crc_of_id() % 3) == 1
    model = langid.fit(docs.filter(~held_out))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"), byte_level(), window=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings").select(
        "vec_id", "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    return negatives.mine(rows, (F.col("vec_id") % 50) == 0, positives=5, wanted=3, scale=256, window=(50, 95))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(read_table(spark, folder, "documents"), least=30, top=2000)


def op13_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The cache starts empty, in a new folder, so that every distinct text is encoded."""
    cache = new_folder(spark, "token-counts")
    docs = read_table(spark, folder, "documents")
    return token_counts.count(docs, public_tokenizers.path("word_bpe_49k.json"), cache, limit=2048)


QUERIES = {
    "op1_html": op1_html,
    "op2_embeddings": op2_embeddings,
    "op3_secrets": op3_secrets,
    "op4_passages": op4_passages,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_binary": op7_binary,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_negatives": op11_negatives,
    "op12_collocations": op12_collocations,
    "op13_tokens": op13_tokens,
}

NEGATIVES_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), found AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other)::INT AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""

COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w
  FROM pieces
), words AS (
  SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM split
), runs AS (
  SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER o AS w2, w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o AS w3,
    w1 || ' ' || lead(w1, 1) OVER o || ' ' || lead(w1, 2) OVER o || ' ' || lead(w1, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY p ORDER BY i)
), grams AS (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS parts FROM grams WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(parts[1:k], ' ') AS head, array_to_string(parts[k + 1:], ' ') AS rest
  FROM candidates, range(1, 4) AS t(k) WHERE k < size
), scored AS (
  SELECT c.*, h.f AS l, r.f AS r, (2000000::HUGEINT * a) // (h.f::HUGEINT + r.f) AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head AND h.size = c.k
  JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest AND r.size = c.size - c.k
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(parts[b:b + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) AS t(m), range(1, 4) AS u(b) WHERE m < size AND b + m - 1 <= size GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op11_negatives": NEGATIVES_SQL, "op12_collocations": COLLOCATIONS_SQL}
