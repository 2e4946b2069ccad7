"""One registered query for each training-data operator, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import bpe_round_trip
from .embed_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .filter_audit import failing_sets, filter_audit
from .license_scan import license_scan
from .line_dedup import line_dedup
from .mixing import mix_sources
from .ngram_join import ngram_join
from .quality import quality_score, train_quality
from .sharding import shard_documents
from .suffix_dedup import suffix_dedup
from .token_count import token_count
from .whitening import embedding_whitening

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_docs(spark, sf_dir), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count("text", tokenizer_path()).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def quality_model(docs: DataFrame, labels: DataFrame):
    """Learned from labelled rows outside the held-out fifth."""
    return train_quality(docs, labels.filter(held_out() != 0))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = docs.select("doc_id", (held_out() == 0).alias("held_out"), quality_score("text", model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", bpe_round_trip("text", tokenizer_path()).alias("coded")).select("doc_id", "coded.ids", "coded.decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_docs(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_docs(spark, sf_dir), n_words=3, percent=90)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_docs(spark, sf_dir).select("doc_id", "text"), match=50)
    return out.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_docs(spark, sf_dir).select("doc_id", "source"))
    return out.select("doc_id", "mix.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir), keep="largest")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(failing_sets(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), n_components=8)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = docs.select("doc_id", license_scan("text", docs).alias("scan"))
    return out.select("doc_id", *[f"scan.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_count": op3_token_count,
    "op4_quality": op4_quality,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
        shared AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN shared s ON lines.key = s.key GROUP BY doc_id""",
    "op10_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS norm FROM documents)
        WINDOW w AS (PARTITION BY norm)""",
    "op11_filter_audit": r"""
        WITH docs AS (
          SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        sets AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(words) < 100)::INT AS a, (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
                 (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT AS c,
                 regexp_matches(text, '[#$%&*|]')::INT AS d,
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e
          FROM docs LEFT JOIN marks USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
          SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
          WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
        failed AS (
          SELECT part, good, toxic, count(*) AS n,
                 concat(if(a = 1, 'A', ''), if(b = 1, 'B', ''), if(c = 1, 'C', ''), if(d = 1, 'D', ''), if(e = 1, 'E', '')) AS fails
          FROM sets GROUP BY ALL),
        steps AS (
          SELECT part, filter_order, step::INT AS step, n, good, toxic, fails, contains(fails, filter_order[step]) AS hit,
                 length(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS earlier
          FROM failed, orders, range(1, 6) s(step)),
        told AS (
          SELECT part, filter_order, step, filter_order[step] AS letter,
                 sum(n) FILTER (NOT hit AND NOT earlier) AS kept, sum(n) FILTER (hit AND NOT earlier) AS removed,
                 sum(n) FILTER (hit AND earlier) AS redundant, sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
                 sum(n * good) FILTER (hit AND NOT earlier) AS good_lost, sum(n * toxic) FILTER (hit AND NOT earlier) AS toxic_lost
          FROM steps GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
        FROM told""",
}
