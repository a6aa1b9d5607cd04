"""Queries over whole tables, one for each operator, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op9_minhash_near_dedup",
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i+4], ' ') END AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), l AS (
      SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
    ), r(id, reach) AS (
      SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach
    ), m AS (SELECT id, min(reach) AS m FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
    """,
)
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _public_tokenizer("byte_bpe_50k.json"), kind="byte", end_id=2, capacity=1024)


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), _public_tokenizer("word_bpe_49k.json"), kind="word", end_id=2)
    return read_token_files(files)


@query(
    "op3_substring_dedup",
    """
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    s AS (
      SELECT doc_id, i, md5(array_to_string(words[i:i+19], ' ')) AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
    ), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
    c AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM r)),
    k AS (SELECT doc_id, i, word FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) ANTI JOIN c USING (doc_id, i)),
    t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
    """,
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.substring_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_media_sniffing")
def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.media import media_digests, store_texts

    return media_digests(store_texts(table(spark, sf_dir, "documents")))


@query("op6_toxicity_ftrl")
def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.toxicity import held_out_rows, score, train

    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"), held_out=held_out_rows(0, 5))
    return score(docs, weights).select("doc_id", held_out_rows(0, 5).alias("held_out"), "score", "predicted")


@query(
    "op5_decontamination",
    """
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
    ), b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
    ), g AS (
      SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i:i+12], ' ') AS g
      FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS i FROM b WHERE len(words) > 0)
    ), ns AS (SELECT DISTINCT n FROM g),
    s AS (
      SELECT doc_id, n, i, array_to_string(words[i:i+n-1], ' ') AS g
      FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, ns WHERE len(words) >= n)
    ), h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON g.n = s.n AND g.g = s.g),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
           coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(words) AS contaminated
    FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
    """,
)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)


@query(
    "op1_perspective_rotation",
    """
    WITH t AS (
      SELECT conv_id, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS block, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
    ), p AS (SELECT DISTINCT conv_id, speaker AS me FROM t WHERE speaker <> 'system'),
    r AS (
      SELECT t.conv_id, p.me, block, turn, speaker, text, speaker = me AS own,
             '<|im_start|>' || CASE WHEN speaker = me THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head,
             text || '<|im_end|>' AS body
      FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id
    ), o AS (
      SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, me, block ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS stop,
             row_number() OVER (PARTITION BY conv_id, me, block ORDER BY turn NULLS FIRST, speaker, text) AS nth FROM r
    )
    SELECT conv_id, me AS perspective, block, count(*) AS n_turns, count(*) FILTER (own) AS n_own, string_agg(head || body || chr(10), '' ORDER BY nth) AS text,
           coalesce(string_agg(CAST(stop - 1 - length(body) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ',' ORDER BY nth) FILTER (own), '') AS mask,
           CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS own_chars
    FROM o GROUP BY conv_id, me, block
    """,
)
def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


@query("op7_quality_cotraining")
def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.quality import co_train, document_views, score_quality
    from memloom.llm.toxicity import held_out_rows

    views = document_views(table(spark, sf_dir, "documents"))
    model = co_train(views, table(spark, sf_dir, "labels"), held_out=held_out_rows(0, 5))
    found = score_quality(views, model)
    return found.select("doc_id", held_out_rows(0, 5).alias("held_out"), "text_score", "meta_score", "score", "predicted", (F.col("predicted") == 1).alias("kept"))


@query("op4_pitman_yor")
def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm.pitman_yor import score_corpus
    from memloom.llm.toxicity import held_out_rows

    return score_corpus(table(spark, sf_dir, "documents"), held_out=held_out_rows(2, 7))
