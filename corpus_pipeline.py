"""Corpus pipeline over ``documents``: five stages of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the
last keep the columns of ``documents`` (a column that is missing reads as null, an extra one
is dropped); ``run`` writes each stage's rows as Parquet to the folder that
``spark.checkpoint.dir`` names and reads them again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import language_id, packing, passages, quality, simhash
from ledgerflow.llm.common import materialise, repeats, small_batches

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}

#: A predicted language whose probability is under so many times that of a guess is no decision.
LEAST_LIFT = 1.2


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told (operator 5).

    The network learns from the stage's own labelled rows. A null text, one
    without letters, or a score under ``LEAST_LIFT`` by the number of languages goes. Where no row has a
    label, nothing can be learned and all texts with letters stay.
    """
    docs = _documents(docs)
    net = language_id.train(docs, "text", "lang", F.col("doc_id"))
    if net is None:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    told = language_id.predict_language(docs, net, score_as="_score", label_as="_label")
    least = min(0.5, LEAST_LIFT / len(net.labels))
    return told.where((F.col("_label") != language_id.UNDETERMINED) & (F.col("_score") >= least)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the quality rules (operator 3)."""
    docs = materialise(_documents(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    kept = quality.quality_rules(docs, id_col="_row").where("kept").select(F.col("doc_id").alias("_row"))
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, a number of each row: the id, unless ids repeat or are null."""
    docs = _documents(docs)
    if docs.where("doc_id IS NULL").isEmpty() and not repeats(docs, "doc_id"):
        return docs.withColumn("_row", F.col("doc_id"))
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest id (operator 8).

    Groups are those of the operator: fingerprints of three-word shingles that link at three bits or fewer, by the grid of
    segment counts. What is left then meets by five-word shingles of similarity 0.8 or more, which so few bits
    seldom find; every document of a group but the first goes. Where ids are null or repeat, each row is a document of its own; null ids come last.
    """
    docs = _rows(docs)
    small_batches(spark)
    left = materialise(_firsts(docs, simhash.near_duplicates(docs, id_col="_row")), "unlinked")
    return _firsts(left, simhash.near_copies(left, id_col="_row")).select(*COLUMNS)


def _firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The first document of each group (``doc_id``, a ``_row``; ``component_id``)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    named = groups.select(F.col("doc_id").alias("_row"), "component_id")
    first = named.join(docs.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first")).select("first._row")
    return docs.join(first, "_row", "left_semi")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document before, in the operator's order, owns (operator 6).

    A cut passage leaves a line break; ``n_chars`` follows the text. A document
    of which nothing is left goes. Where ids are null or repeat, each row is a document of its own.
    """
    docs = _rows(docs)
    small_batches(spark)
    spans = passages.repeated_passages(docs, id_col="_row").groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = materialise(spans, "spans")
    cut = docs.join(spans, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), pa.array([None if t is None else len(t) for t in texts], pa.int64())], list(COLUMNS)
            )

    edited = cut.select(*COLUMNS, "spans").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
    return docs.join(spans, "_row", "left_anti").select(*COLUMNS).unionByName(edited.where("n_chars > 0"))


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` (start, end); a document counts
    its words between ASCII white space."""
    import re

    if text is None:
        return None
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    pieces, at = [], 0
    for start, end in sorted(spans):
        if start >= len(words) or end <= start:
            continue
        begin, stop = words[start][0], words[min(end, len(words)) - 1][1]
        if begin > at:
            pieces.append(text[at:begin])
        at = max(at, stop)
    pieces.append(text[at:])
    return "\n".join(p for p in (x.strip(" \t\n\r\x0b\x0c") for x in pieces) if p)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens (operator 4)."""
    return packing.pack(_documents(docs), "byte_bpe_50k.json")


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the network, XXH64 or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
