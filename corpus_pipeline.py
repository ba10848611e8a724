"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and gives the next stage's docs. Every stage
is written as Parquet to the cluster's shared folder (spark.checkpoint.dir) and read again.

Defined results of every stage: a row's fate depends on the row alone and on the group of copies it belongs to, never on
other rows of the same doc_id; null texts count as empty ones; extra columns pass through unchanged, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flintglass.llm import decontaminate, jaccard_join, line_crf, packing, secret_cnn
from flintglass.llm.registry import default_tokenizer
from flintglass.llm.textops import slices, table, unused
from flintglass.plans.shared import fresh_folder

#: Near duplicates in the pipeline: five-word shingles, Jaccard similarity of 80 % or more.
NEAR_NGRAM, NEAR_PERCENT = 5, 80
#: Rows of an Arrow batch; whole texts travel in them, and the JVM keeps the room of the largest ones.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


#: Columns that stages read by name.
OWN_COLUMNS = ("doc_id", "text", "n_chars")


def any_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage over a table whose other columns have any names: they bear plain ones while it runs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in OWN_COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they are smaller already. A stage's rows are made when
    its caller writes them, so that the setting has to stay until then; run() gives the old one back."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


@any_names
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line labels reject go. Null, empty and blank texts have too few words and go;
    repeated rows share one verdict."""
    small_batches(spark)
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    mark = unused("_q_", docs.columns)
    return line_crf.score_documents(docs, field, docs.columns, mark).filter(F.col(mark + "kept")).select(*docs.columns)


@any_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: that of the smallest doc_id (null ids last). Texts without words
    link with nothing and stay; equal rows are copies of each other; a text under a doc_id that also stands on a copy stays."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs, NEAR_NGRAM, NEAR_PERCENT)


@any_names
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go. Null and empty texts hold none and stay, as do all with an empty benchmark."""
    small_batches(spark)
    mark = unused("_d_", docs.columns)
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), docs.columns, mark)
    return found.filter(F.size(mark + "hits") == 0).select(*docs.columns)


@any_names
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark in the text; n_chars follows the text where it is given. Null texts stay null."""
    small_batches(spark)
    net = secret_cnn.fit(docs)
    schema = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            arrays = list(batch.columns)
            arrays[at] = pa.array([secret_cnn.redacted(t, *found) for t, found in zip(texts, secret_cnn.scan_texts(texts, net), strict=True)], schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    clean = docs.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is one piece of the end mark alone; equal rows give pieces each."""
    small_batches(spark)
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", pack)]
#: The labelling field, the network and the tokenizer cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "pipeline")
    docs, batch_rows = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    finally:
        spark.conf.set(BATCH_SETTING, batch_rows)
    return docs
