"""References to records that do not exist (problem 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.columns import blank_to_null
from paperloom.operators.skew import skew_safe_left_join
from paperloom.session import materialize

#: Keys are cut into blocks of 2**BLOCK_BITS values: the unit of the as-of match. A
#: block has at most so many distinct keys, so no window partition can grow beyond it.
BLOCK_BITS = 12
#: Bits of the chunk's number in its paper, in the integer form of a chunk id.
NUMBER_BITS = 24


def chunk_ordinal(chunk_id: Column) -> Column:
    """The integer form of a chunk id: paper and number in the paper; null without them."""
    number = F.regexp_extract(chunk_id, r"_([0-9]{1,7})_p[0-9]{1,11}$", 1)
    paper = F.regexp_extract(chunk_id, r"_[0-9]{1,7}_p([0-9]{1,11})$", 1)
    return F.when(number != "", F.shiftleft(paper.cast("long"), NUMBER_BITS) + number.cast("long"))


def contiguous_runs(keys: DataFrame, key: str) -> DataFrame:
    """(block, run_start, run_end) of the contiguous runs of the distinct integer keys.

    Runs end at block borders, so each block is an independent window of bounded size.
    """
    block = F.shiftright(F.col(key), BLOCK_BITS)
    distinct = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key)).distinct().select(block.alias("block"), key)
    order = Window.partitionBy("block").orderBy(key)
    # keys of one run share the difference of key and rank
    return (
        distinct.withColumn("_run", F.col(key) - F.row_number().over(order))
        .groupBy("block", "_run")
        .agg(F.min(key).alias("run_start"), F.max(key).alias("run_end"))
        .select("block", "run_start", "run_end")
    )


def beyond_runs(references: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """The distinct reference keys that lie in no run: as-of match to the preceding run
    start in the same block, reported when there is none or the key is past its end."""
    distinct = references.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("at")).distinct()
    events = distinct.select(F.shiftright("at", BLOCK_BITS).alias("block"), "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("run_end")).unionByName(
        runs.select("block", F.col("run_start").alias("at"), F.lit(0).alias("kind"), "run_end")
    )
    order = Window.partitionBy("block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = events.withColumn("_end", F.last("run_end", ignorenulls=True).over(order))
    return matched.where((F.col("kind") == 1) & (F.col("_end").isNull() | (F.col("at") > F.col("_end")))).select(F.col("at").alias(key))


def orphan_references(references: DataFrame, parents: DataFrame, deletions: DataFrame, ordinal: Callable[[Column], Column] = chunk_ordinal) -> DataFrame:
    """(src_table, src_key, ref_id, kind, period): the references that don't hold.

    references (src_table, src_key, ref_id, at), parents (id, arrived_at), deletions
    (id, deleted_at), each with repeats. Blanks around a ref_id are dropped, null and
    blank ones are no references. kind: 'missing' (no parent has the id), 'deleted' (its
    earliest deletion is at or before ``at``), 'late' (its earliest arrival is after
    ``at``). A reference both deleted and late counts as deleted; with null ``at`` it can
    only be missing, with null period. Deletions of ids that never came mean nothing.

    The runs decide: an id beyond them is missing without another look at the parents. An
    id inside a run, or without an integer form, is then compared exactly. All work before
    the last join is on distinct ids; that join is skew-safe, so one id may hold a third of
    all references. The references are written once, since several steps read them.
    """
    refs = references.select("src_table", F.col("src_key").cast("long").alias("src_key"), blank_to_null(F.col("ref_id")).alias("ref_id"), "at").where(F.col("ref_id").isNotNull())
    refs = materialize(refs.distinct(), "references")
    ids = materialize(refs.select("ref_id").distinct().withColumn("_ord", ordinal(F.col("ref_id"))), "reference-ids")
    known = parents.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("arrived_at").alias("arrived_at")).withColumn("_known", F.lit(True))
    runs = contiguous_runs(known.select(ordinal(F.col("id")).alias("_ord")), "_ord")
    beyond = beyond_runs(ids, "_ord", runs).withColumn("_beyond", F.lit(True))
    judged = ids.join(beyond, "_ord", "left")
    missing = judged.where("_beyond").select("ref_id", F.lit(None).alias("arrived_at"), F.lit(None).alias("deleted_at"), F.lit(False).alias("_known"))
    deleted = deletions.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("deleted_at").alias("deleted_at"))
    within = judged.where("_beyond IS NULL").select("ref_id").join(known.withColumnRenamed("id", "ref_id"), "ref_id", "left").join(deleted.withColumnRenamed("id", "ref_id"), "ref_id", "left")
    status = within.select("ref_id", "arrived_at", "deleted_at", F.coalesce("_known", F.lit(False)).alias("_known"))
    types = dict(status.dtypes)
    status = status.unionByName(missing.select("ref_id", *[F.col(c).cast(types[c]) for c in ("arrived_at", "deleted_at")], "_known"))
    found = skew_safe_left_join(refs, status, "ref_id")
    kind = (
        F.when(~F.col("_known"), "missing")
        .when(F.col("deleted_at") <= F.col("at"), "deleted")
        .when(F.col("arrived_at") > F.col("at"), "late")
    )
    return (
        found.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("src_table", "src_key", "ref_id", "kind", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def retrieval_references(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The references of this project's tables, in the operator's form."""
    return questions.select(F.lit("eval_questions").alias("src_table"), F.col("question_id").alias("src_key"), F.explode("relevant_chunk_ids").alias("ref_id"), F.col("created_at").alias("at")).unionByName(
        chunks.select(F.lit("chunks").alias("src_table"), F.col("chunk_key").alias("src_key"), F.explode("conflict_chunk_ids").alias("ref_id"), F.col("linked_at").alias("at"))
    )


def retrieval_orphans(questions: DataFrame, chunks: DataFrame, deletions: DataFrame) -> DataFrame:
    return orphan_references(
        retrieval_references(questions, chunks),
        chunks.select(F.col("chunk_id").alias("id"), F.col("ingested_at").alias("arrived_at")),
        deletions.select(F.col("chunk_id").alias("id"), "deleted_at"),
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references by referring table, month and kind."""
    return orphans.groupBy("src_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("src_key").alias("n_sources"))
