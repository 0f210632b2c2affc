"""Benchmark reports (JSON) to one flat table, its CSV sink, and the line that a timed run gives."""

import resource
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "struct<benchmarks: array<map<string, string>>>"
RUN = "`SF` long, `Batches` long, `Batch-Size` long, `Results` long, `Real-Time(ms)` long, `CPU-Time(ms)` long, `Memory(KiB)` long"


def benchmark_rows(reports: DataFrame, text: str = "value") -> DataFrame:
    """One row per benchmark that ran without an error, from reports, a JSON document a row.

    Documents that aren't reports are skipped, null ones too. Parts of ``name``
    between slashes that look like ``key:value`` become columns, over a column of
    that name if there is one; the second part is ``operator``. Columns are the
    union over all reports, in order of their names; NaN becomes 0.0. A column whose
    values all are numbers is DOUBLE, unless it came from the name; others are STRING.
    """
    rows = reports.select(F.explode(F.from_json(F.col(text), REPORT, {"allowNonNumericNumbers": "true"})["benchmarks"]).alias("b"))
    rows = rows.filter(F.col("b").isNotNull() & (F.coalesce(F.try_element_at("b", F.lit("error_occurred")), F.lit("false")) != "true"))
    rows = rows.withColumn("b", F.transform_values("b", lambda k, v: F.regexp_replace(v, r'^"(NaN|-?Infinity)"$', "$1")))  # as the parser gives numbers that JSON lacks
    parts = F.split(F.try_element_at("b", F.lit("name")), "/")
    pairs = F.transform(F.filter(parts, lambda p: p.contains(":")), lambda p: F.struct(F.split(p, ":")[0].alias("key"), F.split(p, ":")[1].alias("value")))
    named = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))  # the last of a name counts
    rows = rows.select(F.map_concat(F.map_filter("b", lambda k, v: ~k.isin("error_occurred", "operator")), F.create_map(F.lit("operator"), F.try_element_at(parts, F.lit(2)))).alias("own"), F.coalesce(named, F.create_map().cast("map<string,string>")).alias("named"))
    keys = rows.select(F.explode(F.map_concat(F.transform_values("own", lambda k, v: F.struct(F.lit(False).alias("named"), v.alias("v"))), F.map_filter(F.transform_values("named", lambda k, v: F.struct(F.lit(True).alias("named"), v.alias("v"))), lambda k, v: ~F.array_contains(F.map_keys("own"), k)))))
    number = F.col("value.v").isNull() | F.col("value.v").try_cast("double").isNotNull()
    kinds = keys.groupBy("key").agg(F.min(number & ~F.col("value.named")).alias("number"), F.count("value.v").alias("n")).collect()  # column names, few
    over = {r[0] for r in rows.select(F.explode(F.map_keys("named"))).distinct().collect()}

    def column(r) -> Column:
        value = F.coalesce(F.try_element_at("named", F.lit(r.key)), F.try_element_at("own", F.lit(r.key)))
        return (F.nanvl(value.try_cast("double"), F.lit(0.0)) if r.number and r.n and r.key not in over else value).alias(r.key)

    return rows.select(*[column(r) for r in sorted(kinds, key=lambda r: r.key)])


def read_benchmark_json(spark: SparkSession, path: str) -> DataFrame:
    """``benchmark_rows`` of every ``*.json`` file of a folder."""
    return benchmark_rows(spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_line(spark: SparkSession, run: Callable[[], DataFrame], sf: int, batches: int, batch_size: int) -> DataFrame:
    """Runs a relation to its row count; one row with scale, rows, times and peak memory of the driver process."""
    real, cpu = time.time(), time.process_time()
    results = run().count()
    real, cpu = time.time() - real, time.process_time() - cpu
    return spark.createDataFrame([(sf, batches, batch_size, results, int(real * 1000), int(cpu * 1000), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)], RUN)
