"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

All stages but the last return the columns of ``documents``, whatever other columns there are: operators see
doc_id, text and one struct of all the rest, so no name can clash with theirs. Null and blank texts go with the
quality rules (no words). Rows without doc_id are documents of their own: they are judged by their
text, near_duplicates and substring_dedup leave them as they are. Rows that share a doc_id are judged each by its own
text. An empty table runs through and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dynofleet.llm import boosting, chunking, packing, rules, setjoin
from dynofleet.llm.common import forget, stored, table

#: Documents that the classifier scores below this go. Lower than the 0.7 of its query: in doubt a document stays.
KEEP_FROM = 0.5
#: Bytes of a worker's word table, small as the workers go on to serve other stages.
TABLE_BYTES = 50_000_000


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a struct of all other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None).cast("int")).alias("row"))


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """``df`` with the columns of ``docs`` again; ``new`` replaces some."""
    of = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c)
    return df.select(*(new.get(c, of(c)).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; null doc_ids are judged like others."""
    found = rules.learn(docs, table(spark, sf_dir, "labels"))
    return unpacked(rules.measured(packed(docs)).filter(~rules.base_failed() & rules.verdict(found)), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score from KEEP_FROM up; null doc_ids are judged like others."""
    model = boosting.learn(docs, table(spark, sf_dir, "labels"))
    return unpacked(boosting.score(packed(docs), model, ("doc_id", "text", "row")).filter(F.col("score") >= KEEP_FROM), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five words, similarity 0.8) one text of the smallest doc_id.

    Rows that repeat a doc_id and its text go too; of different texts under one doc_id each is judged
    by itself. Rows without doc_id are documents of their own and all stay, whatever they repeat.
    """
    keyed = packed(docs).withColumn("text_hash", F.xxhash64("text"))
    groups = setjoin.grouped(keyed, k=5, num=80, den=100, also=("text_hash",)).filter("component_id = doc_id")
    one = F.struct("doc_id", "text_hash")
    first = groups.filter("group_id is not null").groupBy("group_id").agg(F.min(one).alias("one")).select("one.*")
    kept = first.unionByName(groups.filter("group_id is null").select("doc_id", "text_hash").distinct())
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    named = keyed.join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return unpacked(named, docs).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that come earlier; those of which nothing is left but blanks go.

    n_chars, where there is such a column, counts the text that is left. Rows without doc_id lose nothing.
    """
    cut = chunking.deduplicated(packed(docs)).filter(F.btrim(F.col("text"), F.lit(rules.SPACES)) != "")
    new = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(cut, docs, **new)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 4096 tokens; null doc_ids are packed too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), table_bytes=TABLE_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models, set similarity, rolling hashes and a subword vocabulary are beyond SQL; tests hold it against a planted corpus, and each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs, old = stored(stage(spark, docs, sf_dir)), docs
        forget(old)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
