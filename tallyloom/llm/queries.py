"""The operators of this subpackage bound to the supplied tables.

Each query reads its whole table through its operator and derives the digest
columns from the operator's outputs.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, ctw, decision_list, fill_middle, iso_media, ordinal, packing, secrets, simhash, suffix_dedup, turn_repair, warc, word_bpe
from tallyloom.llm.common import load, text_of


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = ctw.scores(docs, training=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") * -log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, _tokenizer("byte_bpe_50k.json"), window=1024, end_id=0, added_tokens=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, load(spark, sf_dir, "labels"))
    return ordinal.severity(docs, model).select("doc_id", "severity", "grade", "toxic")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    judged, _ = decision_list.quality(docs, load(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, words_in_shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.dedup(docs, width=100)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no capture times; a fixed one for each page stands in.
    pages = load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + F.lit(1_704_067_200)).alias("at"), F.col("html").alias("payload")
    )
    index = warc.captures_index(pages, least_bytes=100)
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    payload = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.encode(text_of(), "UTF-8").alias("payload"))
    read = iso_media.probe(iso_media.store(payload), with_samples=True)
    track, stored = F.element_at("tracks", 1), F.col("sample_bytes")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(stored).cast("long").alias("payload_bytes"),
        F.sha2(stored, 256).alias("payload_sha256"),
        F.crc32(F.substring(stored, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            track.codec,
            track.duration_s.cast("string"),
            track.samples.cast("string"),
            F.array_join(F.transform(track.keyframes, lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ","),
        ).alias("feature"),
    )


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents").select("doc_id", "text"), pieces=True).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")

    def of(kind: int):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < len(secrets.PATTERNS))
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("word_bpe_49k.json")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    both = word_bpe.decode(word_bpe.encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(turn_repair.damaged(load(spark, sf_dir, "conversations")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_middle.transform(docs, seed="7", rate=100, spm_rate=50, unit="line")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_packing": op2_packing,
    "op3_ordinal": op3_ordinal,
    "op4_decision_list": op4_decision_list,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_iso_media": op9_iso_media,
    "op10_entropy_secrets": op10_entropy_secrets,
    "op11_word_bpe": op11_word_bpe,
    "op12_turn_repair": op12_turn_repair,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op8_warc": """
        WITH sized AS (
            SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest
            FROM pages
        ), first AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
        FROM first""",
    "op13_fill_middle": """
        WITH lines AS (
            SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
                   sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), drawn AS (
            SELECT *, CAST(len(u) AS BIGINT) AS n,
                   CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM lines
        ), cut AS (
            SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
                   array_to_string(u[greatest(c1, c2) + 1:], '') AS s
            FROM drawn
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM cut""",
}
