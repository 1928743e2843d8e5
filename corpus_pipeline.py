"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns of ``documents``.  Rows with a null id pass the
near-duplicate stage, since ids name what stays; otherwise nulls, empty texts and
empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decision_list, packing, secrets, shingle_sets, suffix_dedup
from tallyloom.llm.common import load, text_of, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    held = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    judged, _ = decision_list.quality(held, load(spark, sf_dir, "labels"))
    # Written first: a filter on the verdict would be pushed below the statistics and repeat their expressions.
    return written(judged.select("whole", "kept"), "judged").where("kept").select("whole.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by fingerprints or by similar sets of five-word shingles."""
    found = shingle_sets.near_duplicates(docs.select("doc_id", "text"))
    stay = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "stay")
    single = docs.join(stay.where("rows = 1"), "doc_id", "left_semi")
    # An id that stands on several rows of its group: one row of each text stays.
    several = docs.join(stay.where("rows > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes or more that stand earlier in the corpus."""
    found = suffix_dedup.dedup(docs, width=100, whole_characters=True)
    text = F.col("kept").cast("string")
    values = {c: F.col("carried").getField(c) for c in docs.columns if c not in ("doc_id", "text")}
    values |= {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(values[c].alias(c) for c in docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mark."""
    found = secrets.scan(docs, pieces=True).withColumn("text", secrets.redacted(text_of(), F.col("secret_spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0, added_tokens=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("secret_scans", secret_scans),
    ("packed", packed),
]

#: The learned rules, XXH64 fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
