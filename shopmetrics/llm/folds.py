"""Folds by id, and bounded samples of labelled rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a row without id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int],
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(label, text)`` of at most ``bounds[k]`` labelled ids of each kind ``k``.

    Ids are chosen by their hash. The chosen ids are bounded by a parameter, so
    they are broadcast; only their rows leave the text scan. Where an id repeats
    among the documents, its least text (by hash) stands for it, so an id
    that repeats often counts no more than any other.
    """
    one = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    chosen = None
    for kind, bound in bounds.items():
        part = one.filter(F.col("label") == kind).orderBy(F.xxhash64(id_col), id_col).limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = documents.select(id_col, F.col(text_col).alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), id_col)
    return (rows.groupBy(id_col, "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .select(F.col("label").cast("int").alias("label"), "text"))
