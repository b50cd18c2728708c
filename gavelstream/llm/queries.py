"""The registered queries opN_<name>, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.llm import bpe, exact_dedup, fingerprint, html_text, importance, mixing, periodic_runs, pii, secrets, simhash, substring_dedup, toxicity, url_filter
from gavelstream.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"), F.size("passages").alias("n_passages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    kinds = [_count(k) for k in secrets.KINDS]
    return found.select("doc_id", *kinds, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"))


def _count_base(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["learned"])).cast("long").alias(f"n_{kind}")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["learned"])
    counts = [_count_base(k) for k in pii.KINDS]
    learned = F.size(F.filter("spans", lambda s: s["learned"])).cast("long").alias("n_learned")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), learned, F.size("spans").cast("long").alias("n_found"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(table(spark, sf_dir, "documents"))
    return mixture.documents.select("doc_id", "size", "source_size", "target", "taken")


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edit_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("body", 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "cut_by_counts", "cut_by_roles")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.plant_repeats(table(spark, sf_dir, "documents")))
    start, length, period = (F.col(f"strongest.{c}") for c in ("start", "length", "period"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: Host, path and verdict of op13's rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_RULE_VALUES = ", ".join(map(str, URL_RULES))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the rules; where none fits, addresses that several pages share are listed."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_VALUES} AS t(host, path, verdict)")
    return url_filter.judge_urls(pages, rules, url_filter.repeated_urls(pages))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secrets": op3_secrets,
    "op4_personal_data": op4_personal_data,
    "op5_source_mixing": op5_source_mixing,
    "op6_multiset_fingerprint": op6_multiset_fingerprint,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_html_text": op10_html_text,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_url_filter": op13_url_filter,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32's table as a list, and a byte of a text's hexadecimal form.
_CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) FROM range(256) t(b))"
_BYTE = "(strpos('123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('123456789ABCDEF', h[2 * i + 2]))"


ORACLE_SQL = {
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS body
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM d)
        ), firsts AS (
            SELECT body, min(doc_id) AS first_id FROM windows GROUP BY body
        ), covered AS (
            SELECT DISTINCT doc_id, i + j AS place FROM windows JOIN firsts USING (body), range(13) r(j) WHERE first_id < doc_id
        ), placed AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n FROM placed ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM d
    """,
    # a lag can only have a run where four words, each a lag further, are equal
    "op11_periodic_runs": rf"""
        WITH split AS (
            SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, hex(encode(doc_id::VARCHAR)) AS h FROM documents
        ), hashed AS (
            SELECT place, doc_id, w, len(w) AS n,
                   xor(list_reduce(list_transform(range(length(h) // 2), lambda i: {_BYTE}::BIGINT), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
            FROM split, (SELECT {_CRC_TABLE} AS crc_table)
        ), repeated AS (
            SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashed
        ), planted AS (
            SELECT place, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM repeated
        ), words AS MATERIALIZED (
            SELECT place, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, place * 1000000000 + generate_subscripts(w, 1) - 1 AS spot FROM planted
        ), probes AS (
            SELECT place, lag, place * 1000000000 + lag * unnest(range((n - 1) // lag - 2)) AS spot FROM (SELECT place, n, unnest(range(1, n // 4 + 1)) AS lag FROM planted)
        ), two AS MATERIALIZED (
            SELECT p.place, lag, p.spot, a.word FROM probes p JOIN words a USING (spot)
        ), three AS MATERIALIZED (
            SELECT t.* FROM two t JOIN words b ON b.spot = t.spot + lag AND b.word = t.word
        ), four AS MATERIALIZED (
            SELECT t.* FROM three t JOIN words b ON b.spot = t.spot + 2 * lag AND b.word = t.word
        ), lags AS MATERIALIZED (
            SELECT DISTINCT t.place, lag FROM four t JOIN words b ON b.spot = t.spot + 3 * lag AND b.word = t.word
        ), whole AS MATERIALIZED (
            SELECT place, lag, i, spot, word FROM lags JOIN words USING (place)
        ), agreeing AS (
            SELECT t.place, lag, t.i, t.i - row_number() OVER (PARTITION BY t.place, lag ORDER BY t.i) AS island
            FROM whole t JOIN words b ON b.spot = t.spot + lag AND b.word = t.word AND b.place = t.place
        ), stretches AS (
            SELECT place, lag, min(i) AS start, count(*) + lag AS length FROM agreeing GROUP BY place, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)
        ), runs AS (
            SELECT place, start, length, min(lag) AS period FROM stretches GROUP BY place, start, length
        ), listed AS (
            SELECT place, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                   arg_max((start, length, period), (length::DOUBLE / period, -start, -period)) AS best
            FROM runs GROUP BY place
        ), dropped AS (
            SELECT DISTINCT place, i FROM words JOIN runs USING (place) WHERE i BETWEEN start + period AND start + length - 1
        ), kept AS (
            SELECT place, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN dropped USING (place, i) GROUP BY place
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM planted LEFT JOIN listed USING (place) LEFT JOIN kept USING (place)
    """,
    "op12_importance_resampling": rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS place, doc_id, text, true AS is_document FROM documents
            UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark
        ), split AS (
            SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
        ), features AS (
            SELECT place, is_document, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM split
        ), hexed AS (
            SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM features)
        ), numbered AS (
            SELECT feature, list_transform(range(length(h) // 2), lambda i: {_BYTE}::BIGINT) AS body FROM hexed
        ), hashed AS (
            SELECT feature, xor(list_reduce(body, lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM numbered, (SELECT {_CRC_TABLE} AS crc_table)
        ), placed AS (
            SELECT place, is_document, bucket FROM features JOIN hashed USING (feature)
        ), counts AS (
            SELECT bucket, (count(*) FILTER (is_document))::DOUBLE AS s, (count(*) FILTER (NOT is_document))::DOUBLE AS t FROM placed GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS gain FROM counts
        ), weighed AS (
            SELECT place, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE is_document GROUP BY place
        ), scored AS (
            SELECT place, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
            FROM split LEFT JOIN weighed USING (place) WHERE is_document
        ), ended AS (
            SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM scored
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS rank, 25 * (count(*) FILTER (able) OVER ()) // 100 AS k FROM ended
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= k THEN rank END AS rank FROM ranked
    """,
    "op13_url_filter": rf"""
        WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_VALUES}),
        rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), addressed AS (
            SELECT *, CASE WHEN host = '' THEN NULL ELSE regexp_replace(host, '^www[.]', '') || rtrim(path, '/') END AS address FROM parts
        ), judged AS (
            SELECT *, address IS NOT NULL AND count(*) OVER (PARTITION BY address) > 1 AS listed,
                   (SELECT max((length(rule_host || rule_path), rule_host || rule_path, rule_verdict)) FROM r
                    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
            FROM addressed
        )
        SELECT page_id, host, path, best[2] AS rule, coalesce(best[3], CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM judged
    """,
}
