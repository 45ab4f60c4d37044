"""The registered queries of this package, with production parameters.

Each applies its operator to whole tables and derives the asked digest columns
from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulesieve.llm import (
    alignment,
    infill,
    language_model,
    licenses,
    matroska,
    packing,
    quality,
    secret_scan,
    sentencepieces,
    simhash,
    substrings,
    topk,
    toxicity,
)
from rulesieve.llm.common import bound_batches, documents, id_text

WINDOW = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; it runs with bounded Arrow batches."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates within 4 bits of 64, over 4-word shingles."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("n_links").cast("long").alias("n_links"),
    )


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    vectors = documents(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that earlier documents hold."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substrings.without_repeats(docs).select(
        "doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of the held-out fold teach nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.toxicity(docs, documents(spark, sf_dir, "labels")).drop("text")


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under the mixture, learned from all but the held-out fold."""
    return language_model.interpolated(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query
def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as samples in Matroska, and what is read back from the packets."""
    docs = documents(spark, sf_dir).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        matroska.media(matroska.padded_payload(F.col("text"))).alias("media"),
    )
    read = docs.withColumn("file", matroska.parsed(F.col("media")))
    read = read.withColumn("payload", matroska.samples(F.col("media"), F.col("file.packets")))
    last = F.element_at("file.packets", -1)
    cued = F.forall("file.cues", lambda c: F.array_contains("file.clusters", c["cluster"]))
    feature = F.concat_ws(
        ":",
        "file.codec",
        F.size("file.packets"),
        F.size("file.clusters"),
        F.size("file.cues"),
        cued.cast("string"),
        F.aggregate("file.packets", F.lit(0).cast("long"), lambda total, p: total + p["size"]),
        last["track"],
        last["timestamp_ns"],
        last["offset"],
        F.coalesce("file.error", F.lit("complete")),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, plain and confirmed."""
    docs = documents(spark, sf_dir).select("doc_id", secret_scan.secret_spans(F.col("text")).alias("found"))

    def of_kind(*kinds: str):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    return docs.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        F.sha2(listed(of_kind(*secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


@query
def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded from its ids again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", sentencepieces.encoded(F.col("text"), model).alias("ids")
    )
    both = docs.withColumn("back", sentencepieces.decoded(F.col("ids"), model))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("back", 256).alias("decoded_sha256"),
        (F.coalesce("text", F.lit("")) == F.col("back")).alias("round_trip"),
    )


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels of the held-out fold teach nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.quality(docs, documents(spark, sf_dir, "labels")).drop("text")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    pieces = packing.token_pieces(
        id_text(documents(spark, sf_dir)),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        WINDOW,
    )
    digests = pieces.select("id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.assign_sequences(digests, WINDOW).withColumnRenamed("id", "doc_id")


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens by two tokenizers, grouped, linked and counted."""
    found = alignment.aligned(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        digest=True,
    )
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its middle moved to the end, and rebuilt from that."""
    found = infill.infilled(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every text names or quotes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.license_labels(docs).select(
        "doc_id",
        "license.n_words",
        F.size("license.starts").cast("long").alias("n_base"),
        F.array_min("license.starts").cast("long").alias("first_word"),
        F.array_max("license.starts").cast("long").alias("last_word"),
        F.array_join("license.base_labels", ",").alias("base_labels"),
        F.array_join("license.labels", ",").alias("labels"),
        "license.score",
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _license_sql() -> str:
    """Phrases and templates by brute force over all windows of all texts."""
    chosen = licenses.template_parameters(licenses.TEMPLATES, licenses.THRESHOLD)
    templates = ", ".join(f"({t['number']}, '{t['label']}', {t['words']}, {t['need']}, {t['window']})" for t in chosen)
    phrases = ", ".join(f"('{label}', {licenses.plain_words(phrase)})" for phrase, label in licenses.PHRASES)
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH t(number, label, words, need, win) AS (VALUES {templates}),
        p(label, words) AS (VALUES {phrases}),
        d AS (
            SELECT *, row_number() OVER () AS r FROM (
                SELECT doc_id, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                FROM documents)),
        b AS (
            SELECT r, i AS pos, p.label
            FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM d) x JOIN p ON w[i + 1:i + len(p.words)] = p.words),
        k AS (
            SELECT r, t.*, w, unnest(range(0, greatest(1, (len(w) + win // 2 - 1) // (win // 2) - 1))) * (win // 2) AS pos
            FROM d JOIN t ON len(list_intersect(t.words, d.w)) >= t.need),
        o AS (
            SELECT r, label, len(list_intersect(words, w[pos + 1:pos + win])) AS n, need, len(words) AS size FROM k),
        f AS (SELECT r, label, n / size AS share FROM o WHERE n >= need),
        l AS (SELECT r, label FROM b UNION SELECT r, label FROM f)
        SELECT d.doc_id, len(w) AS n_words,
               (SELECT count(*) FROM b WHERE b.r = d.r) AS n_base,
               (SELECT min(pos) FROM b WHERE b.r = d.r) AS first_word,
               (SELECT max(pos) FROM b WHERE b.r = d.r) AS last_word,
               coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM b WHERE b.r = d.r), '') AS base_labels,
               coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM l WHERE l.r = d.r), '') AS labels,
               coalesce((SELECT max(1.0::DOUBLE) FROM b WHERE b.r = d.r), (SELECT max(share) FROM f WHERE f.r = d.r), 0.0) AS score
        FROM d"""


ORACLES: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        x AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win),
        g AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at
            FROM x JOIN f USING (win) WHERE doc_id > first),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS at FROM d),
        k AS (
            SELECT p.doc_id, string_agg(p.w[p.at], ' ' ORDER BY p.at) AS kept, count(*) AS n
            FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed,
               sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op12_infill": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        x AS (
            SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                             OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        y AS (
            SELECT *, least(c1, c2) AS p, greatest(c1, c2) - least(c1, c2) AS m FROM x),
        z AS (
            SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, m) AS mid, substring(t, p + m + 1) AS suf FROM y)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN m END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM z""",
    "op13_licenses": _license_sql(),
}
