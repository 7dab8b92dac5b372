"""The operators as registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import repaired_turns
from .common import table
from .decontam import decontamination_report
from .exact_dedup import exact_duplicates
from .filter_audit import filter_flags, filter_interactions
from .language_id import predicted_languages
from .line_dedup import without_repeated_passages
from .mixing import mix
from .near_dup import near_duplicates
from .packing import packed_documents
from .prefix_trie import prefix_trie, spliced
from .quality import quality_scores
from .token_counts import prefix_token_counts
from .token_output import read_token_pages, write_token_pages


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fit_chars")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = write_token_pages(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_pages(pages).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, similarity=85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_turns(table(spark, sf_dir, "conversations"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return filter_interactions(filter_flags(docs, table(spark, sf_dir, "labels")), docs.count())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*spliced(table(spark, sf_dir, "conversations"), every=5, longest=9)).drop("turn_digest")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packing = packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_output": op5_token_output,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), marks AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), flags AS (
            SELECT t.part, len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B, 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS C,
                   regexp_matches(text, '[#$%&*|]') AS D, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS E, coalesce(good = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
            FROM t LEFT JOIN marks USING (doc_id)
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
        ), orders AS (
            SELECT l AS filter_order FROM letters UNION ALL SELECT filter_order || l FROM orders, letters WHERE NOT contains(filter_order, l)
        ), counted AS (
            SELECT part, [A, B, C, D, E] AS f, good, toxic, count(*) AS n FROM flags GROUP BY ALL
        ), replayed AS (
            SELECT part, filter_order, f, good, toxic, n, list_transform([1, 2, 3, 4, 5], lambda s: f[ascii(filter_order[s]) - 64]) AS failing FROM counted, orders WHERE length(filter_order) = 5
        ), steps AS (
            SELECT *, coalesce(list_position(failing, true), 6) AS first, unnest([1, 2, 3, 4, 5]) AS step FROM replayed
        ), audit AS (
            SELECT part, filter_order, step::INT AS step, filter_order[step] AS filter, sum(n * (first > step)::INT)::BIGINT AS kept, sum(n * (first = step)::INT)::BIGINT AS removed,
                   sum(n * (failing[step] AND first < step)::INT)::BIGINT AS redundant, sum(n * (failing[step] AND len(list_filter(f, lambda x: x)) = 1)::INT)::BIGINT AS unique_fails,
                   sum(n * (first = step AND good)::INT)::BIGINT AS good_lost, sum(n * (first = step AND toxic)::INT)::BIGINT AS toxic_lost
            FROM steps GROUP BY ALL
        )
        SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM audit
    """,
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), sizes AS (
            SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
        ), c AS (
            SELECT conv_id, n, conv_id - conv_id % 5 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b:
                       list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 9 AS h
            FROM sizes
        ), rebuilt AS (
            SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= h
            UNION ALL
            SELECT c.conv_id, t.pos - h + least(h, coalesce(s.n, 0)), role, text FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN sizes s ON s.conv_id = c.base WHERE t.pos > h
        ), seqs AS (
            SELECT c.conv_id, coalesce(r.turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list(sha256(concat(strlen(role), ':', role, text)) ORDER BY pos) AS turns FROM rebuilt GROUP BY conv_id) r USING (conv_id)
        ), prefixes AS (
            SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM seqs
        ), sizes_of AS (
            SELECT conv_id, pos, strlen(text) AS bytes FROM rebuilt
        ), nodes AS (
            SELECT p.turns[1:depth] AS path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(z.bytes, 0)) AS bytes, coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE len(p.turns) = depth), '') AS ended
            FROM prefixes p LEFT JOIN sizes_of z ON z.conv_id = p.conv_id AND z.pos = depth GROUP BY 1, 2
        ), kids AS (
            SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
        ), below AS (
            SELECT a.path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM nodes a JOIN nodes b ON b.path[1:a.depth] = a.path LEFT JOIN kids k ON k.path = b.path GROUP BY 1
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
        FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS shingle
            FROM w, unnest(range(1, greatest(len(words) - 1, 2))) AS t(i)
            WHERE len(words) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), edges AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id AS root, doc_id FROM documents UNION SELECT reach.root, edges.b FROM reach JOIN edges ON edges.a = reach.doc_id
        ), comp AS (
            SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
        FROM documents d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM n
    """,
}
