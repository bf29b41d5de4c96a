"""A corpus pipeline: five operators in a row, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; each is written as Parquet before the next, and a
stage's table goes once the next one is written.

Defined results: a null or empty text is not toxic, links with nothing, holds no passage
and no personal data, and has no tokens; a row without a doc_id passes the near-duplicate
stage; of rows that repeat a doc_id one stays there; extra columns pass all stages
unchanged, whatever their names, but for ``ids`` and ``n_tokens``, which the last stage
makes; an empty table gives no rows. Without labels of both kinds nothing is toxic unless
every label says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, decontaminate, jaccard, pii, toxicity
from logweave.llm.common import discard, keep, table
from logweave.llm.katz import held

#: A trained model, alignments and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. The model never learns from held-out labels."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held("doc_id", 3, 1))
    # numbered names, so that no column of the documents meets one of the operator's
    own = docs.toDF(*(x if x == "text" else f"c{i}" for i, x in enumerate(docs.columns)))
    return toxicity.score(own, model).where(F.col("score") < toxicity.THRESHOLD).select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a Jaccard similarity of 0.8 on five-word shingles one stays."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets; n_chars follows the text."""
    out = pii.mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian uint32) of each text; a text that would not decode to itself is an error."""
    out = bpe.encode_decode(docs.drop("n_tokens", "ids"), bpe.default_vocabulary())
    same = F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("a text does not decode to itself")).cast("binary"))
    rest = [x for x in docs.columns if x not in ("text", "n_tokens", "ids", "decoded")]
    return out.select(*rest, "n_tokens", ids.alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage-{i}")
        discard(*before)
        before = [docs]
    return docs
