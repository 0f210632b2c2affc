"""A bounded sample of labelled texts for training, gathered to the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import held_out, text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = 1500, id_column: str = "doc_id", text_column: str = "text") -> tuple[list[str], list[int], float]:
    """(texts, labels, share of label 1 among all training labels).

    At most ``per_class`` rows of each class reach the driver, whole and of any
    length: those of the smallest hash of the id, never from the held-out fold. An
    id with contradictory labels is left out; of several texts of an id the one
    that sorts first counts. So the sample depends on the tables' rows alone.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z"))
    rows = rows.filter("y = z").drop("z")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("id", F.lit("sample")), F.col("id")]
    picked = rows.filter("y = 0").orderBy(*order).limit(per_class).unionAll(rows.filter("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).join(F.broadcast(picked), "id")  # 2 * per_class rows at most
    found = texts.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy("id").collect()
    total = sum(counts.values())
    return [r["text"] for r in found], [r["y"] for r in found], counts.get(1, 0) / total if total else 0.5
