"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Quality, near-duplicates and benchmark passages drop documents; personal data is generalised within
texts, and ``n_chars``, where there is one, follows the text; the last stage adds token ids and decodes
them.  Null texts are empty texts, and null and repeated keys are kept apart by their texts; of equal
rows the near-duplicate stage keeps one.  Empty tables stay empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import bpe, overlap, privacy, quality, tiling
from shelfline.llm.common import Scratch, remainder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the rows op2 learns from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every component of near copies.

    Links are SimHash fingerprints within three bits, and five-word Jaccard similarity of 0.8 or more, which
    catches the near copies whose fingerprints lie farther apart.
    """
    return overlap.deduplicated(docs, distance=3)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and revealing terms generalised."""
    clean = privacy.sanitised(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids and piece offsets; ``round_trip`` says if the ids decode to the text.

    Columns named ``ids``, ``piece_offsets``, ``n_tokens`` or ``round_trip`` are replaced.
    """
    return bpe.encode(docs, bpe.vocabulary_path(), checked="round_trip")


STAGES = [("quality classifier", quality_stage), ("SimHash near-dedup", near_dedup_stage),
          ("benchmark decontamination", decontaminate_stage), ("PII", privacy_stage),
          ("byte-level BPE", tokens_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
