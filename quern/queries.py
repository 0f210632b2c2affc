"""The catalogue: each operator as a query over the test tables, with the same in SQL."""

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern import operators as op
from quern.functions import minimum, round_up_multiple, round_up_pow2, with_wang32
from quern.sources import benchmark_rows, dense_index, fk_batch_local, random_relation, table
from quern.types import checked_u32

M = 0xFFFFFFFF
BATCH = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def staged(key: str, source: str, keep: str = "") -> str:
    """SQL that adds the 32-bit mix of ``key`` as ``h``, a sub-select per step."""
    steps = [
        f"(h + (xor((h << 15) & {M}, {M}))) & {M}",
        "xor(h, h >> 10)",
        f"(h + ((h << 3) & {M})) & {M}",
        "xor(h, h >> 6)",
        f"(h + (xor((h << 11) & {M}, {M}))) & {M}",
        "xor(h, h >> 16)",
    ]
    cols = f"{keep}, " if keep else ""
    out = f"SELECT {cols}{key} & {M} AS h FROM {source}"
    for s in steps:
        out = f"SELECT {cols}{s} AS h FROM ({out})"
    return f"({out})"


def u32_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a uniform unsigned value ``v`` and a batch number."""
    ev = table(spark, d, "events").select("event_id", (F.col("event_id") / BATCH).cast("long").alias("batch_id"))
    return with_wang32(ev, "event_id", "v")


EV = "(SELECT event_id, event_id // 1024 AS batch_id, h AS v FROM " + staged("event_id", "events", "event_id") + ")"


@query(f"SELECT event_id, v FROM {EV} WHERE v < 1073741824")
def filter_lt_u32(spark, d):
    return op.filter_lt(u32_events(spark, d)).select("event_id", "v")


@query(f"SELECT count(*) AS n FROM {EV} WHERE v < 1073741824")
def filter_count(spark, d):
    return op.count_rows(op.filter_lt(u32_events(spark, d)))


@query(f"SELECT event_id, v < 1073741824 AS keep FROM {EV}")
def filter_mask(spark, d):
    return op.mask_lt(u32_events(spark, d)).select("event_id", "keep")


@query(f"SELECT event_id, v FROM {EV} WHERE v < 1073741824")
def filter_mask_then_filter(spark, d):
    return op.filter_mask(op.mask_lt(u32_events(spark, d))).select("event_id", "v")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey < 5000")
def filter_pushed(spark, d):
    return op.filter_lt(table(spark, d, "lineitem"), "l_orderkey", 5000).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT CAST(sum(v) AS BIGINT) AS sum_v FROM {EV}")
def sum_u32(spark, d):
    return op.scalar_agg(u32_events(spark, d), out="sum_v")


@query(f"SELECT batch_id, CAST(sum(v) AS BIGINT) AS partial_sum FROM {EV} GROUP BY batch_id")
def sum_partials(spark, d):
    return op.partial_sums(u32_events(spark, d))


@query(f"SELECT CAST(sum(partial_sum) AS BIGINT) AS total FROM (SELECT batch_id, sum(v) AS partial_sum FROM {EV} GROUP BY batch_id)")
def sum_partial_final(spark, d):
    return op.merge_partials(op.partial_sums(u32_events(spark, d)))


@query(f"SELECT CAST((sum(CAST(v AS HUGEINT) * 4611686018427387904)) % 18446744073709551616 AS DECIMAL(20,0)) AS sum_v FROM {EV}")
def sum_u64_wrapping(spark, d):
    big = F.pmod((F.col("v").cast("decimal(18,0)") * F.lit(Decimal(1 << 62))).cast("decimal(38,0)"), F.lit(Decimal(1 << 64)))
    return op.sum_wrapping(u32_events(spark, d).select(big.alias("big")), "big", "sum_v")


@query(f"SELECT CAST(sum(v) AS BIGINT) AS sum_v, count(v) AS count_v, min(v) AS min_v, max(v) AS max_v, CAST(sum(v) AS DOUBLE) / count(v) AS avg_v FROM {EV}")
def scalar_aggs(spark, d):
    fns = ["sum", "count", "min", "max", "avg"]
    return op.scalar_aggs(u32_events(spark, d), fns, "v", [f"{f}_v" for f in fns])


@query(f"SELECT CAST(sum(CAST(v AS HUGEINT)) % 18446744073709551616 AS DECIMAL(20,0)) AS sum_v FROM {EV}")
def sum_u64(spark, d):
    return op.sum_u32(u32_events(spark, d), "v", "sum_v")


@query(f"SELECT event_id, v FROM {EV}")
def u32_domain(spark, d):
    return checked_u32(u32_events(spark, d), "v").select("event_id", "v")


@query(f"SELECT event_id, least(v, event_id * 400000) AS low FROM {EV}")
def minimum_of_two(spark, d):
    return u32_events(spark, d).select("event_id", minimum(F.col("v"), F.col("event_id") * 400_000).alias("low"))


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


JOIN = "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(JOIN)
def join_inner_fk_pk(spark, d):
    return op.inner_join(_lines(spark, d), _orders(spark, d), "l_orderkey", "o_orderkey")


@query("SELECT * FROM (SELECT l_orderkey // 2000 AS batch_id, l_orderkey, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey AND l_orderkey // 2000 = p_partkey // 500)")
def join_partition_wise(spark, d):
    left = table(spark, d, "lineitem").select((F.col("l_orderkey") / 2000).cast("long").alias("batch_id"), "l_orderkey", "l_partkey")
    right = table(spark, d, "part").select((F.col("p_partkey") / 500).cast("long").alias("batch_id"), "p_partkey", "p_size")
    return op.partition_wise_join(left, right, "l_partkey", "p_partkey")


@query(JOIN)
def join_radix(spark, d):
    return op.radix_join(_lines(spark, d), _orders(spark, d), "l_orderkey", "o_orderkey")


@query("SELECT l_orderkey // 8000 AS group_id, l_orderkey, l_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey AND l_orderkey // 8000 = p_partkey // 2000 WHERE l_orderkey // 8000 < (SELECT (max(p_partkey) // 500 + 1) // 4 FROM part)")
def join_by_partition_size(spark, d):
    left = table(spark, d, "lineitem").select((F.col("l_orderkey") / 2000).cast("long").alias("batch_id"), "l_orderkey", "l_partkey")
    right = table(spark, d, "part").select((F.col("p_partkey") / 500).cast("long").alias("batch_id"), "p_partkey", "p_size")
    batches = right.agg(F.max("batch_id")).first()[0] + 1
    return op.join_by_batches(left, right, "l_partkey", "p_partkey", 4, batches)


@query("SELECT l_orderkey // 8000 AS group_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND l_orderkey // 8000 = p_partkey // 2000 GROUP BY ALL")
def join_counts_by_group(spark, d):
    left = table(spark, d, "lineitem").select((F.col("l_orderkey") / 2000).cast("long").alias("batch_id"), "l_partkey")
    right = table(spark, d, "part").select((F.col("p_partkey") / 500).cast("long").alias("batch_id"), "p_partkey")
    return op.join_by_batches(left, right, "l_partkey", "p_partkey", 4).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS n")
def join_noop(spark, d):
    return op.count_rows(op.noop_join(_lines(spark, d), _orders(spark, d), "l_orderkey", "o_orderkey"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority, l_partkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_dup_build(spark, d):
    return op.inner_join(_orders(spark, d), _lines(spark, d), "o_orderkey", "l_orderkey")


@query(JOIN + " WHERE o_orderkey % 3 = 0")
def join_unmatched(spark, d):
    return op.inner_join(_lines(spark, d), _orders(spark, d).filter(F.col("o_orderkey") % 3 == 0), "l_orderkey", "o_orderkey")


@query("SELECT c_custkey, c_name AS name_l, n_name AS name_r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_suffixes(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("fk"), F.col("c_name").alias("name"))
    right = table(spark, d, "nation").select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("name"))
    return op.inner_join(left, right).drop("fk")


@query("SELECT l_orderkey AS k, max(l_partkey) AS idx FROM lineitem GROUP BY l_orderkey")
def hash_build(spark, d):
    return op.hash_build(_lines(spark, d), "l_orderkey", "l_partkey")


@query("SELECT event_id, user_id, idx FROM events JOIN (SELECT o_custkey AS k, max(o_orderkey) AS idx FROM orders GROUP BY o_custkey) ON user_id = k")
def hash_probe(spark, d):
    built = op.hash_build(_orders(spark, d), "o_custkey", "o_orderkey")
    return op.hash_probe(table(spark, d, "events").select("event_id", "user_id"), built, "user_id")


@query("SELECT l_orderkey, l_linenumber, o_custkey AS idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def hash_probe_strict(spark, d):
    built = op.hash_build(_orders(spark, d), "o_orderkey", "o_custkey")
    return op.hash_probe(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), built, "l_orderkey", strict=True)


@query("SELECT CAST(sum(n) AS BIGINT) AS build_rows, count(*) AS build_keys, max(n) AS longest_chain FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def join_hash_stats(spark, d):
    return op.hash_stats(_lines(spark, d), "l_orderkey")


OH = staged("o_orderkey", "orders", "o_orderkey, o_custkey")


@query(f"SELECT o_orderkey, o_custkey, h >> 27 AS part_id FROM {OH}")
def partition_assign(spark, d):
    return op.partition_by(_orders(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey", 32)


@query(f"SELECT o_orderkey, o_custkey, h % 10 AS part_id FROM {OH}")
def partition_mod(spark, d):
    return op.partition_by(_orders(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey", 10, radix=False)


@query("SELECT o_orderkey, ((o_orderkey * 65536) & 4294967295) >> 27 AS part_id FROM orders")
def partition_identity(spark, d):
    o = _orders(spark, d).select("o_orderkey", (F.col("o_orderkey") * 65536).alias("k"))
    return op.partition_by(o, "k", 32, mix=False).drop("k")


@query(f"SELECT o_orderkey, o_custkey FROM {OH} WHERE h >> 29 = 5")
def partition_one_bucket(spark, d):
    return op.all_buckets(op.partition_by(_orders(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey", 8), 8)[5].drop("part_id")


@query(f"SELECT batch_id, part_id, n, CAST(sum(n) OVER (PARTITION BY batch_id ORDER BY part_id) AS BIGINT) AS end_offset FROM (SELECT o_orderkey // 1024 AS batch_id, h >> 28 AS part_id, count(*) AS n FROM {OH} GROUP BY ALL)")
def partition_histogram(spark, d):
    o = _orders(spark, d).select("o_orderkey", (F.col("o_orderkey") / 1024).cast("long").alias("batch_id"))
    return op.partition_histogram(op.partition_by(o, "o_orderkey", 16))


@query(f"SELECT o_orderkey, h >> 27 AS part_id, row_number() OVER (PARTITION BY h >> 27 ORDER BY o_orderkey) - 1 AS slot FROM {OH}")
def partition_offsets(spark, d):
    return op.scatter_positions(op.partition_by(_orders(spark, d).select("o_orderkey"), "o_orderkey", 32), "o_orderkey")


@query(f"SELECT h >> 27 AS part_id, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS payload FROM {OH} GROUP BY ALL")
def partition_payload(spark, d):
    return op.partition_by(_orders(spark, d), "o_orderkey", 32).groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("payload"))


@query(f"SELECT o_orderkey, o_custkey, h >> 27 AS part_id FROM {OH}")
def partition_exchange(spark, d):
    """The task that holds a row after the exchange is its bucket."""
    moved = op.shuffle_to_buckets(op.partition_by(_orders(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey", 32), 32)
    return moved.select("o_orderkey", "o_custkey", F.spark_partition_id().cast("long").alias("part_id"))


@query("SELECT event_id, user_id AS i, o_custkey FROM events JOIN (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) ON user_id = pos")
def take_global(spark, d):
    data = op.positions(_orders(spark, d).select("o_orderkey", "o_custkey"), "o_orderkey").drop("o_orderkey")
    return op.take(table(spark, d, "events").select("event_id", F.col("user_id").alias("i")), data)


@query("SELECT batch_id, event_id, i, o_custkey FROM (SELECT event_id // 1024 AS batch_id, event_id, user_id % 1024 AS i FROM events) JOIN (SELECT o_orderkey // 1024 AS b, o_orderkey % 1024 AS pos, o_custkey FROM orders) ON b = batch_id AND i = pos")
def take_batched(spark, d):
    idx = table(spark, d, "events").select((F.col("event_id") / 1024).cast("long").alias("batch_id"), "event_id", (F.col("user_id") % 1024).alias("i"))
    data = _orders(spark, d).select((F.col("o_orderkey") / 1024).cast("long").alias("batch_id"), (F.col("o_orderkey") % 1024).alias("pos"), "o_custkey")
    return op.take_batched(idx, data)


@query("SELECT o_custkey % 7 AS batch_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS pos FROM orders")
def take_batch_positions(spark, d):
    return op.batch_positions(_orders(spark, d).select((F.col("o_custkey") % 7).alias("batch_id"), "o_orderkey"), "o_orderkey")


@query("SELECT k, h FROM " + staged("event_id", "(SELECT event_id, event_id AS k FROM events)", "k"))
def wang_hash(spark, d):
    return with_wang32(table(spark, d, "events").select(F.col("event_id").alias("k")), "k")


@query("SELECT event_id, xor(xor(k >> 33, k), (k % 9007199254740992) << 11) & 4294967295 AS h FROM (SELECT event_id, event_id * 1000003 AS k FROM events)")
def key64_hash(spark, d):
    from quern.functions import key64_hash as h

    return table(spark, d, "events").select("event_id", h(F.col("event_id") * 1000003).alias("h"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 100")
def concat_all(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_custkey")
    return op.concat_all(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), o.filter("o_orderkey < 100"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey")
def sort_multi(spark, d):
    return op.sort_by(table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey")


@query("SELECT o_custkey, o_orderpriority FROM orders")
def drop_key(spark, d):
    return _orders(spark, d).drop("o_orderkey")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer")
def add_index(spark, d):
    return op.positions(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "idx")


@query("SELECT o_orderkey, o_custkey, c_acctbal FROM orders JOIN customer ON o_orderkey = c_custkey")
def add_column(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey"), "o_custkey", F.col("o_orderkey").alias("pos"))
    right = table(spark, d, "customer").select("c_acctbal", F.col("c_custkey").alias("pos"))
    return op.add_columns(left, right, "pos").drop("pos")


@query("SELECT i AS pk, i // 1000 AS batch_id FROM range(8000) t(i)")
def index_column(spark, d):
    return dense_index(spark, 8, 1000)


@query("SELECT event_id, batch_id, batch_id * 512 + v % 512 AS fk FROM " + EV)
def fk_column(spark, d):
    ev = table(spark, d, "events").select("event_id", (F.col("event_id") / BATCH).cast("long").alias("batch_id"))
    return ev.withColumn("fk", fk_batch_local(F.col("batch_id"), F.col("event_id"), 512))


@query("SELECT o_orderkey, (o_orderkey + 7) // 8 * 8 AS up8, CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << CAST(length(bin(o_orderkey - 1)) AS BIGINT) END AS pow2 FROM orders")
def round_up(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k, round_up_multiple(k).alias("up8"), round_up_pow2(k).alias("pow2"))


@query(
    """
    SELECT 'BM_Join/' || n_name || '/SF:' || n_regionkey AS name, n_name AS operator, CAST(n_regionkey AS VARCHAR) AS "SF", CASE WHEN n_nationkey % 5 = 3 THEN 0.0 ELSE n_nationkey + 0.5 END AS real_time, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS DOUBLE) END AS cycles
    FROM nation WHERE n_nationkey % 4 <> 1"""
)
def results_etl(spark, d):
    """Reports made of nations, one a region, some with errors, NaN or counters that others lack, and one that is no JSON."""
    key = F.col("n_nationkey")
    fields = [F.lit('{"name": "BM_Join/'), F.col("n_name"), F.lit("/SF:"), F.col("n_regionkey"), F.lit('", "real_time": '), F.when(key % 5 == 3, F.lit("NaN")).otherwise(F.concat(key.cast("string"), F.lit(".5"))), F.when(key % 2 == 0, F.concat(F.lit(', "cycles": '), key)).otherwise(F.lit("")), F.when(key % 4 == 1, F.lit(', "error_occurred": true}')).otherwise(F.lit("}"))]
    reports = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.concat(*[f.cast("string") for f in fields])).alias("b"))
    reports = reports.select(F.concat(F.lit('{"context": {}, "benchmarks": ['), F.array_join("b", ", "), F.lit("]}")).alias("value"))
    return benchmark_rows(reports.unionAll(spark.createDataFrame([("no report",), (None,)], "value string")))


RANDOM = StructType([StructField("v", LongType(), False, {"min": 0, "max": 9}), StructField("s", StringType(), True, {"null_probability": 0.5}), StructField("d", StringType(), False, {"values": ["red", "green", "blue"]}), StructField("t", LongType(), False, {"time": 1000})])


@query("SELECT CAST(8000 AS BIGINT) AS rows, CAST(8 AS BIGINT) AS batches, CAST(10 AS BIGINT) AS values, CAST(3 AS BIGINT) AS words, true AS in_range, true AS some_null")
def random_columns(spark, d):
    """What holds for any seed: the values themselves are no engine's but ours."""
    df = random_relation(spark, RANDOM, 8, 1000)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("batch_id").alias("batches"), F.countDistinct("v").alias("values"), F.countDistinct("d").alias("words"), F.min(F.col("v").between(0, 9) & F.col("t").between(0, 86_399_999)).alias("in_range"), (F.count("s").between(3600, 4400)).alias("some_null"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return join_inner_fk_pk(spark, d)
