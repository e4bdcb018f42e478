"""A training corpus from raw documents: quality, line dedup, near-dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each stage's rows as Parquet to the shared
folder and reads them as the next one's documents. All stages but the last give the columns of documents, whatever other
columns these have. SQL can express neither the classifier nor the tokenizer, so ORACLE_SQL is None; a test holds ``run`` against a
plain version of all five stages on a small table.

Null and empty texts pass through as they are: the classifier scores them as empty, they have no lines, are no copies, have no
words and so are not in the mix. A null source is a source of its own. Rows that repeat an id are one document: they go or stay
together; a row without an id stays, as nothing can name it. Texts of any length are one row. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linekin.llm.common import small, stored, table
from linekin.llm.lines import without_repeats
from linekin.llm.minhash import near_duplicates
from linekin.llm.mixing import mixed_documents
from linekin.llm.pieces import encoded
from linekin.llm.quality import kept_documents
from linekin.plans.shipping import ship

ORACLE_SQL: str | None = None

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand, within two edits, in an earlier place; n_chars follows the text."""
    ship(spark)
    # Other columns go under numbers, as the operator adds counts of its own.
    own = [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]
    found = without_repeats(docs.toDF(*own))
    size = F.char_length("text").cast("long")
    return found.select(*[size.alias(c) if c == "n_chars" else F.col(k).alias(c) for k, c in zip(own, docs.columns, strict=True)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    ship(spark)
    gone = stored(near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "near-copies")
    # Few ids go to every task; more are joined by a shuffle.
    gone = small(gone, 1_000_000)
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them, in the order of their training positions."""
    ship(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each document of the mix."""
    import public_tokenizers

    ship(spark)
    rows = docs.select(F.struct("doc_id", "source").alias("doc_id"), "text")
    found = encoded(rows, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id.doc_id", "doc_id.source", F.size("ids").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("SentencePiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
