"""The subpackage's queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary, chat, decontam, dedup, divergence, html, packing, quality, repeats, secrets, simhash, warc
from .common import scratch, table, written

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), all_hashes=True).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files, a replica with a bit flipped in some records, and the audit's finding for each record."""
    one, other = scratch(spark, "warc"), scratch(spark, "warc-replica")
    index = warc.write_warc(table(spark, sf_dir, "pages"), one)
    warc.copied(index, one, other, F.col("page_id") % 97 == 5)
    bad = warc.audit(index, one, other).withColumn("damaged", F.lit(True))
    return index.join(bad, ["shard", "seq"], "left").select("page_id", "n_bytes", F.lower(F.hex("record_sha256")).alias("record_sha256"), F.coalesce("damaged", F.lit(False)).alias("damaged"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), with_ids=False)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    of = lambda kinds: f"filter(spans, s -> s.kind in ({', '.join(map(repr, kinds))}))"
    text = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select("doc_id", *[F.expr(f"cast(size({of([k])}) as bigint)").alias(f"n_{k}") for k in base], F.expr(f"sha2({text(of(base))}, 256)").alias("base_sha256"), F.expr(text("spans")).alias("spans"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.read_tokens(binary.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end=2), with_ids=False)


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(case)
    return chat.digests(written(chat.format_chats(turns), "chats"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), stored=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_html_extraction, op3_exact_dedup, op4_warc_fixity, op5_packing, op6_secret_scan, op7_quality_classifier, op8_simhash_near_dedup, op9_token_binary, op10_chat_formatting, op11_token_alignment, op12_repeated_passages, op13_source_divergence)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), chr(26), chr(26) || chr(26))"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(26) || '{c[1:]}')"
    return out


ORACLE_SQL = {
    "op3_exact_dedup": f"""
        WITH h AS (SELECT doc_id, sha256({_LOW}) AS text_sha256, row_number() OVER (ORDER BY doc_id) AS uid FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, uid) = 1 AS kept, text_sha256
        FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_warc_fixity": """
        WITH r AS (SELECT page_id, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
               || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
               || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS raw FROM pages)
        SELECT page_id, octet_length(raw) AS n_bytes, sha256(raw) AS record_sha256, coalesce(page_id % 97 = 5, false) AS damaged FROM r""",
    "op10_chat_formatting": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '{CONTROL_CASE}'), (-1, 1, 'assistant', '{CONTROL_CASE}'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_escaped("role")}) + len(role) - len(replace(role, chr(10), '')) + length({_escaped("text")}) + {len(chat.OPEN) + len(chat.CLOSE) + 2}) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op13_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS uid, {_LOW} AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
             w AS (SELECT uid, lang, source, unnest(regexp_extract_all(t, '{divergence.TERM}')) AS term FROM d),
             c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
             k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT uid) >= {divergence.LEAST}),
             g AS (SELECT DISTINCT lang, source FROM d),
             f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS m FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             s AS (SELECT lang, source, term, n, CAST(1 + {divergence.UNIT}::HUGEINT * (n + {divergence.SMOOTH}) // (sum(n) OVER x + {divergence.SMOOTH} * count(*) OVER x) AS BIGINT) AS p,
                          CAST(1 + {divergence.UNIT}::HUGEINT * (m + {divergence.SMOOTH}) // (sum(m) OVER x + {divergence.SMOOTH} * count(*) OVER x) AS BIGINT) AS q FROM f WINDOW x AS (PARTITION BY lang, source)),
             v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                          LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
        QUALIFY part = 'pair' OR rank <= {divergence.TOP}""",
}
