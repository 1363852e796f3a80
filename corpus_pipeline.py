"""The corpus pipeline: documents pass through STAGES in order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents.  All but the last return the columns of ``documents``;
stages that change a text keep ``n_chars`` its number of code points.

1. toxicity: documents that the classifier rejects go.
2. ngram_join: of each group of near duplicates the row with the smallest id stays.
3. suffix_dedup: byte strings of DEPTH bytes that a smaller document has are cut out.
4. secret_scans: found secrets are masked.
5. packing: what is left is packed into sequences; one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.llm.common import materialise, read_table
from freshet.llm.ngram_join import similar_groups
from freshet.llm.packing import pack_documents
from freshet.llm.secrets import mask_secrets
from freshet.llm.suffix_dedup import remove_repeats
from freshet.llm.toxicity import without_toxic

ORACLE_SQL = None


def _named(docs):
    """The rows with columns _keep0, _keep1 and so on beside doc_id and text, so that no name clashes; and what gives the names back."""
    inner = {c: c if c in ("doc_id", "text") else f"_keep{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inner.items()])

    def restored(df, changed: bool):
        n_chars = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
        return df.select(*[(n_chars if changed and c == "n_chars" else F.col(a)).alias(c) for c, a in inner.items()])

    return plain, [a for a in inner.values() if a.startswith("_keep")], restored


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier of the labelled rows rejects go; null and empty texts have the score of the intercept.

    Rows with equal or null ids are judged one by one; without labels all stay.
    """
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def ngram_join(spark, docs, sf_dir):
    """One row of each group of near duplicates stays: that with the smallest id, rows without one last; of equal ids any one.

    Ids may be null or repeated: rows go by a key of id and text.  Texts without words are in no
    group and stay, all rows of them.
    """
    plain, _, restored = _named(docs)
    # A key of the row's id and text: equal rows share it, and should two others, both stay.
    keyed = plain.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = similar_groups(keyed, "_row").groupBy("_row").agg(F.min("component_id").alias("component_id"), F.max("n_shingles").alias("_n"))
    named = groups.join(keyed.groupBy("_row").agg(F.min("doc_id").alias("_id")), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row", "_n")).alias("_first")).select("_first._row", "_first._n").distinct()
    equal = Window.partitionBy("_row", "doc_id", F.xxhash64(F.lit(1), F.col("text"))).orderBy("_row")
    left = keyed.join(first, "_row").withColumn("_copy", F.row_number().over(equal))
    return restored(left.filter("_copy = 1 or _n = 0"), False)


def suffix_dedup(spark, docs, sf_dir):
    """Bytes that a smaller id has too are cut out, at whole characters; all rows stay, null texts as empty ones.

    Rows with equal ids cut nothing of each other, those without an id come last.
    """
    plain, keep, restored = _named(docs)
    cut = remove_repeats(plain, with_text=True, keep=tuple(keep))
    return restored(cut.select("doc_id", F.col("kept_text").alias("text"), *keep), True)


def secret_scans(spark, docs, sf_dir):
    """Found secrets are masked; all rows stay, null texts as they are."""
    plain, _, restored = _named(docs)
    return restored(mask_secrets(plain), True)


def packing(spark, docs, sf_dir):
    """One row per piece of every row's text; null and empty texts are a separator alone."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("suffix_dedup", suffix_dedup), ("secret_scans", secret_scans), ("packing", packing)]


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
