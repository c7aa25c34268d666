"""A training corpus from raw documents: five stages, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and reads it again as the next one's documents. All but the last return the columns
of documents, others that come with them included, whatever their names; the last returns the mix.
Rows are documents by doc_id and text: rows that repeat both are one document, that keeps or loses
the same. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.decontaminate import contamination
from spanloom.llm.jaccard_join import similar_documents
from spanloom.llm.line_dedup import cleaned
from spanloom.llm.mixing import mix_shards
from spanloom.llm.shared import join_same, materialize, text_key
from spanloom.llm.toxicity import fit_grammar, toxicity_score

TOXIC = 0.7
#: SQL can neither learn the toxicity grammar nor draw the mix; the tests compare with brute force.
ORACLE_SQL = None


def _keep(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, tk) is in ``keys``; ``once``: repeated rows only once. The given
    rows travel as a struct, where no name can clash."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_key(F.col("text")).alias("tk"))
    kept = join_same(rows, keys, ["doc_id", "tk"], "left_semi")
    return (kept.dropDuplicates(["doc_id", "tk"]) if once else kept).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The grammar is learned from labelled rows of these documents.
    Null and empty texts score like any without a match, and stay."""
    grammar = fit_grammar(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_score(F.col("text"), grammar) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out of the texts, and n_chars follows; a document
    that loses all its lines goes. Null texts and those of fewer than three lines stay as they are."""
    d = cleaned(docs.select("*")).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_removed") == 0, F.col("row")["n_chars"]).otherwise(F.length("clean_text").cast("long"))
    new = {"text": F.col("clean_text"), "n_chars": n_chars}
    return d.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 5-gram similarities of 0.8 or more, the smallest doc_id stays; a missing
    doc_id comes last. Null and wordless texts are like no others and stay."""
    first = similar_documents(docs, with_key=True).where("first").select("doc_id", "tk").distinct()
    return _keep(docs, first, once=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go; null and empty texts stay."""
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_key=True)
    return _keep(docs, judged.where("not contaminated").select("doc_id", "tk"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: ``shard, place, source, n_words, text`` for each block of the mix, in the order of
    its shards and places, and ``doc_ids``, the documents that its words are from, in order. Null and
    wordless texts have nothing to give."""
    _, shards = mix_shards(docs)
    doc_ids = F.transform("spans", lambda x: x["doc_id"]).alias("doc_ids")
    return shards.select("shard", "place", "source", F.col("use").alias("n_words"), "text", doc_ids)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
