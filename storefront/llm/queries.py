"""The operators as registered queries, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.llm.archives import MIN_REVISIT, archive_round_trip
from storefront.llm.byte_repeats import remove_repeated_bytes
from storefront.llm.conversation_trie import FORKS, SHARED_TURNS, forked_trie
from storefront.llm.decontam import find_leaks
from storefront.llm.licenses import scan_licenses
from storefront.llm.mixing import mix
from storefront.llm.near_dup import near_duplicates
from storefront.llm.order_minhash import as_text, fingerprints, likeness
from storefront.llm.quality import resample
from storefront.llm.secrets import scan_secrets
from storefront.llm.token_align import align_tokenizers
from storefront.llm.word_repeats import remove_repeats
from storefront.llm.urls import GLOB_RULES, HOST_RULES, judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess")


def op2_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents")).drop("row_key", "component")


def op4_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_table(spark, folder, "documents"))


def op5_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprints(_table(spark, folder, "documents"))
    own, other, after = F.col("tuples"), F.col("edited_tuples"), F.col("next_tuples")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )


def op6_count_min_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = remove_repeats(_table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_bwt_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = remove_repeated_bytes(_table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"))


def op9_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    rows = archive_round_trip(_table(spark, folder, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_token_incidence(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokenizers(_table(spark, folder, "documents"))


def op12_peeled_trie(spark: SparkSession, folder: str) -> DataFrame:
    return forked_trie(_table(spark, folder, "conversations")).drop("n_ends", "bytes", "k1", "k2")


def op13_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan_licenses(_table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        "n_found",
    )


QUERIES: dict[str, Query] = {
    "op1_secret_spans": op1_secret_spans,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_bbit_minhash": op3_bbit_minhash,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_order_minhash": op5_order_minhash,
    "op6_count_min_windows": op6_count_min_windows,
    "op7_bwt_merge": op7_bwt_merge,
    "op8_url_rules": op8_url_rules,
    "op9_importance_resample": op9_importance_resample,
    "op10_arc_to_warc": op10_arc_to_warc,
    "op11_token_incidence": op11_token_incidence,
    "op12_peeled_trie": op12_peeled_trie,
    "op13_license_rules": op13_license_rules,
}


def _url_sql() -> str:
    host_rules = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    fits = [
        f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in host_rules
    ]
    globs = ["concat('.', host, '#', path) GLOB '{}'".format(r.glob) for r in GLOB_RULES]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in zip(fits, host_rules))
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in zip([*fits, *globs], [*host_rules, *GLOB_RULES]))
    hosts = " ".join(f"WHEN {c} THEN NULL" for c in fits)
    glob = " ".join(f"WHEN {c} THEN '{r.glob}'" for c, r in zip(globs, GLOB_RULES))
    return f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), parts AS (
        SELECT page_id,
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest
    )
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
        CASE {verdict} ELSE 'allow' END AS verdict,
        CASE {hosts} {glob} ELSE NULL END AS glob
    FROM parts
    """


#: A page's id, bytes, digest, type and reference; ids, dates and versions of records are not SQL's to make.
_ARCHIVE_SQL = f"""
    WITH bytes AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), kept AS (
        SELECT payload_digest, max(page_id) AS keeper FROM bytes
        WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
    FROM bytes LEFT JOIN kept USING (payload_digest)
"""

#: CRC-32, bit by bit: a character is one step, and eight steps shift it out.
_CRC = """
    xor(list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
                            WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
    ), 4294967295)
"""

#: Prefixes as lists of turns; a node adds to every prefix of its own.
_TRIE_SQL = f"""
    WITH convs AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                             ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns, {_CRC} % {SHARED_TURNS} AS h
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS t
        FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % {FORKS}
    ), members AS (
        SELECT conv_id, len(t) AS n, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt
    ), nodes AS (
        SELECT depth, t[1:depth] AS seq, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
        FROM members GROUP BY ALL
    ), families AS (
        SELECT u.depth - 1 AS depth, u.seq[1:u.depth - 1] AS seq, count(*) AS n_children
        FROM nodes u WHERE u.depth > 0 GROUP BY ALL
    ), whole AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families USING (depth, seq)
    ), lines AS (
        SELECT (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(seq[depth].text) END AS saved,
            n_children = 0 AS leaf, seq, unnest(range(0, depth + 1)) AS above FROM whole
    ), sums AS (
        SELECT above AS depth, seq[1:above] AS seq, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM lines GROUP BY ALL
    )
    SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
    FROM whole w JOIN sums s USING (depth, seq)
    LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.seq = w.seq[1:w.depth - 1]
"""

ORACLES: dict[str, str] = {"op8_url_rules": _url_sql(), "op10_arc_to_warc": _ARCHIVE_SQL, "op12_peeled_trie": _TRIE_SQL}
