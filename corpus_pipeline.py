"""From raw documents to token ids: five stages, each a corpus operator.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last
return the columns of ``docs``.

Defined cases: no documents give no rows; without labels nothing is toxic; texts that
are NULL or have no letters leave at the language stage; repeated rows count as
copies, of which one stays; of a group whose documents have no id, one stays; the
last stage replaces a column ``ids``; other columns pass under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.llm import jaccard, langid, mixing, sentencepiece, toxicity
from pickwell.session import materialise

MIN_LANGUAGE_SHARE = 0.5


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns a stage needs; all others in one struct, where no name of the stage's own meets them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*others).alias("_others")] if others else []))


def _columns(df: DataFrame, like: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``like`` again."""
    return df.select(*[F.col(c) if c in needed else F.col("_others").getField(c).alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; learned from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    known = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    scored = toxicity.score(_packed(docs, "text"), toxicity.learn(docs, known), name="_toxicity")
    return _columns(scored.filter(F.col("_toxicity") < 0.5), docs, "text")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was recognised and that covers half of their letters or more."""
    model = langid.learn(langid.training(docs.select("doc_id", "text", "lang")))
    labelled = langid.identify(_packed(docs, "text"), model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SHARE)
    return _columns(labelled.filter(known), docs, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _columns(jaccard.keep_one(_packed(docs, "doc_id", "text")), docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix."""
    needed = "doc_id", "text", "source"
    return _columns(mixing.mix(_packed(docs, *needed)), docs, *needed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their text."""
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# trained models and a seeded draw are not SQL; a test compares run() with a plain chain over texts on the driver
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
