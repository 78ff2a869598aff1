"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decompose, dominance, fingerprint, hardneg, jaccard, langid, mixing, packing, perplexity, substring, suffix, warc
from ..sources.scratch import owned
from .common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir))


CONFLICT = "<|im_end|><|im_start|>assistant ok"


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render(turns.unionByName(hard)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir), vocabulary())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose id is divisible by 50; where it is divisible by 7, the label moves on by one."""
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(v.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.decompose_documents(table(spark, sf_dir), vocabulary())


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = dominance.sale_points(table(spark, sf_dir, "sales"))
    return dominance.count_above(points).select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("weight_above").alias("n_rows"))


# Parts of the queries above that SQL can express, so that they can be held against it.


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir).select("source", mixing.words(F.col("text")).alias("size"))
    return mixing.targets(sized).select("source", "source_size", F.round("target", 4).alias("target"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.base_rules(table(spark, sf_dir))


def suffix_array_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir)).select("doc_id", "start", "n_words")


Query = Callable[[SparkSession, str], DataFrame]


def _owning(query: Query) -> Query:
    """The query, which deletes the tables that it has staged and its result does not read."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with owned(spark) as own:
            out = query(spark, sf_dir)
            own.release(keep=out, tables_only=True)
        return out

    return run


_QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mix_sources": op2_mix_sources,
    "op3_chat_round_trip": op3_chat_round_trip,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_suffix_array": op8_suffix_array,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_power_of_two": op12_power_of_two,
    "op13_dominance": op13_dominance,
    "fingerprint_edits": fingerprint_edits,
    "mix_targets": mix_targets,
    "quality_base_rules": quality_base_rules,
    "suffix_array_spans": suffix_array_spans,
}

QUERIES: dict[str, Query] = {name: _owning(query) for name, query in _QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER r AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW r AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER r <= 3""",
    "op13_dominance": """
        WITH c AS (
            SELECT *, list_reduce(
                list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(CAST(sale_id AS VARCHAR), ''), ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)) AS state
            FROM sales
        ), s AS (
            SELECT sale_id, CAST(floor(epoch_us(sold_at) / 60000000) AS BIGINT) AS slot,
                   CAST(floor(floor(100::DOUBLE * total + 0.5) / 1) AS BIGINT) AS level,
                   1 + xor(state, 4294967295::BIGINT) % 5 AS weight
            FROM c
        ), n AS (
            SELECT a.slot, a.level, count(*) AS n_sales, sum(b.weight) AS n_rows
            FROM (SELECT DISTINCT slot, level FROM s) a JOIN s b ON b.slot < a.slot AND b.level > a.level GROUP BY 1, 2
        )
        SELECT sale_id, s.slot, s.level, CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(n_sales, 0) END AS n_sales,
               CAST(CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(n_rows, 0) END AS BIGINT) AS n_rows
        FROM s LEFT JOIN n ON n.slot = s.slot AND n.level = s.level""",
    "op3_chat_round_trip": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
        s AS (
            SELECT *, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS n
            FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
        ),
        r AS (SELECT doc_id, i, word, n = 35 AND count(*) OVER (PARTITION BY words, n) > 1 AS repeated FROM s),
        c AS (
            SELECT *, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
            FROM r
        ),
        k AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                   string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
            FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op6_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
        s AS (
            SELECT *, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS k
            FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
        ),
        g AS MATERIALIZED (SELECT DISTINCT doc_id, words FROM s WHERE k = 5 OR (n < 5 AND i = 0)),
        z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        e AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM g a JOIN g b ON a.words = b.words AND a.doc_id <> b.doc_id
            JOIN z za ON za.doc_id = a.doc_id JOIN z zb ON zb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, za.n, zb.n
            HAVING 9 * count(*) >= 4 * (za.n + zb.n)
        ),
        r(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x
        ),
        c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
        l AS (SELECT x, count(*) AS n FROM e GROUP BY x)
        SELECT c.doc_id, c.class_id, coalesce(l.n, 0) AS n_links FROM c LEFT JOIN l ON l.x = c.doc_id""",
    "fingerprint_edits": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
        SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(following, 1, length(t) // 2)) AS edited_sha256 FROM n""",
    "mix_targets": r"""
        WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
        l AS (
            SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM w
        )
        SELECT source, source_size, round(least(cap, weight * (SELECT max(level) FROM l)), 4) AS target FROM l""",
    "quality_base_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
        g AS (SELECT *, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM g),
        r AS (SELECT doc_id, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM c),
        k AS (SELECT doc_id, count(*) FILTER (covered) AS n FROM r GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        f AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words
            FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f""",
    "suffix_array_spans": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
        s AS (
            SELECT *, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS n
            FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
        ),
        r AS (SELECT doc_id, i, n = 50 AND count(*) OVER (PARTITION BY words, n) > 1 AS repeated FROM s),
        c AS (SELECT *, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
        g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c WHERE gone)
        SELECT doc_id, min(i) AS start, count(*) AS n_words FROM g GROUP BY doc_id, island""",
}
