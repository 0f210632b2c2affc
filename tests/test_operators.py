"""Literal fixtures and edge cases: empty input, ragged batches, nulls, one partition, unsigned values."""

import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, DayTimeIntervalType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, YearMonthIntervalType

from quern import operators as op
from quern import queries as catalogue
from quern.functions import minimum, round_up_multiple, round_up_pow2, wang32
from quern.plans import dense_positions
from quern.sources import dense_index, join_sides, literal, random_relation, random_u32, read_benchmark_json, run_line, take_indices, write_csv
from quern.streaming import batch_stream, streaming_filter, streaming_sum
from quern.types import checked_u32, u32, u32_schema

V = u32_schema("v", nullable=True)
LEFT = ([0, 2, 3, 8, 9, 10, 12, 13, 18, 19], [0] * 5 + [1] * 5)
RIGHT = ([3, 8, 9, 0, 12, 13, 18, 19, 10, 2], [53, 58, 59, 50, 62, 63, 68, 69, 60, 52], [0] * 5 + [1] * 5)


def sides(spark):
    left = literal(spark, "fk long, v_l long, batch_id long", LEFT[0], [100 + k for k in LEFT[0]], LEFT[1])
    right = literal(spark, "pk long, v_r long, batch_id long", *RIGHT)
    return left, right


def test_filter_literals(spark):
    assert op.filter_lt(literal(spark, V, [0, 2, 3, 8, 9])).count() == 5
    rows = spark.range(4096).select(F.when(F.col("id").isin(5, 8, 9, 100, 270), F.col("id")).otherwise(F.col("id") + (1 << 30)).alias("v"), "id")
    assert [r.v for r in op.filter_lt(rows).orderBy("id").collect()] == [5, 8, 9, 100, 270]


def test_filter_splits_the_input_and_drops_nulls(spark):
    df = literal(spark, V, [None, 1, (1 << 31) + 5, (1 << 30)])
    assert [r.v for r in op.filter_lt(df).collect()] == [1]
    assert df.filter(~(F.col("v") < (1 << 30))).count() == 2


def test_signed_bits_read_as_unsigned(spark):
    df = spark.createDataFrame([(-1,), (5,)], "v int").select(u32("v").alias("v"))
    assert sorted(r.v for r in df.collect()) == [5, 0xFFFFFFFF]
    assert op.filter_lt(df).count() == 1


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("v"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t"))
    plan = op.filter_lt(spark.read.parquet(str(tmp_path / "t"))).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(v,1073741824)" in plan and "wide" not in plan


def test_sums(spark):
    df = literal(spark, V, [0, 2, 3, 8, 9])
    assert op.scalar_agg(df).first()[0] == 22
    assert op.scalar_agg(df).columns == ["sum(v)"]
    assert op.scalar_agg(df.limit(0)).first()[0] is None
    near = literal(spark, V, [(1 << 63) - 1] * 3)
    assert int(op.sum_wrapping(near).first()[0]) == 3 * ((1 << 63) - 1) % (1 << 64)
    with pytest.raises(Exception, match="OVERFLOW"):
        op.scalar_agg(near).collect()
    with pytest.raises(ValueError):
        op.scalar_agg(df, "median")


def test_take_literals(spark):
    data = literal(spark, "pos long, v long", range(5), [0, 2, 3, 8, 9])
    idx = literal(spark, "n long, i long", range(5), [0, 1, 4, 4, 99])
    assert [r.v for r in op.take(idx, data).orderBy("n").collect()] == [0, 2, 9, 9]


def test_positions_are_dense(spark):
    df = literal(spark, V, [7, 7, None, 100, -5])
    got = op.positions(df, "v").collect()
    assert sorted(r.pos for r in got) == [0, 1, 2, 3, 4]
    assert {r.pos: r.v for r in got}[4] == 100 and {r.pos: r.v for r in got}[0] is None
    assert op.positions(df.limit(0), "v").count() == 0


def test_join_literals(spark):
    left, right = sides(spark)
    want = sorted((k, 100 + k, 50 + k) for k in LEFT[0])
    l, r = left.drop("batch_id"), right.drop("batch_id")
    assert sorted(map(tuple, op.inner_join(l, r).collect())) == want
    for n in (1, 2, 32):
        assert sorted(map(tuple, op.radix_join(l, r, n=n).collect())) == want
    near = op.partition_wise_join(left, right).select("fk").collect()
    assert sorted(r.fk for r in near) == [0, 3, 8, 9, 10, 13, 18, 19]


def test_join_bag_nulls_and_misses(spark):
    left = literal(spark, "fk long, a long", [1, 1, 2, None], [1, 2, 3, 4])
    right = literal(spark, "pk long, a long, b long", [1, 1, 3, None], [5, 6, 7, 8], [0, 0, 0, 0])
    out = op.inner_join(left, right)
    assert out.columns == ["fk", "a_l", "a_r", "b"] and out.count() == 4
    assert op.radix_join(left, right, n=4).count() == 4
    with pytest.raises(ValueError):
        op.require_matches(left, right)
    assert op.require_matches(left.filter("fk = 1"), right).count() == 2
    assert op.inner_join(left.limit(0), right).count() == 0


def test_radix_join_plan_has_one_exchange_a_side(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false"), spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = spark.range(1000).select(F.col("id").alias("fk")), spark.range(1000).select(F.col("id").alias("pk"), (F.col("id") * 2).alias("x"))
        plans = [op.radix_join(left, right, n=8, hint=h)._jdf.queryExecution().executedPlan().toString() for h in (None, "shuffle_hash")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true"), spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all(p.count("Exchange") == 2 for p in plans) and "ShuffledHashJoin" in plans[1]
    assert op.radix_join(left, right).count() == 1000  # as many buckets as shuffle partitions


def test_hash_values_and_buckets(spark):
    df = literal(spark, "k long", [0, 2, 3, 8])
    got = {r.k: r.h for r in df.select("k", wang32(F.col("k")).alias("h")).collect()}
    assert got == {0: 0x4636B9C9, 2: 0xFF4D1170, 3: 0x2BF062CF, 8: 0x5A4D3AAF}
    for n, want in ((1, [0, 0, 0, 0]), (2, [0, 1, 0, 0]), (4, [1, 3, 0, 1]), (32, [8, 31, 5, 11])):
        assert [r.part_id for r in op.partition_by(df, "k", n).orderBy("k").collect()] == want


def test_partition_literals(spark):
    df = literal(spark, "pk long, x long", [0, 2, 3, 8], [100, 101, 102, 103])
    parts = op.partition_by(df, "pk", 2)
    assert {(r.part_id, r.n) for r in parts.groupBy("part_id").agg(F.count("*").alias("n")).collect()} == {(0, 3), (1, 1)}
    assert [tuple(r) for r in parts.filter("part_id = 1").select("pk", "x").collect()] == [(2, 101)]
    with pytest.raises(ValueError):
        op.partition_by(df, "nope", 2)
    with pytest.raises(ValueError):
        op.partition_by(df, "pk", 0)
    with pytest.raises(ValueError):
        op.partition_by(df, "pk", 3)


def test_partition_is_even_disjoint_cover(spark):
    df = dense_index(spark, 8, 4096).select("pk", random_u32(F.col("pk"), 1).alias("x"))
    counts = op.partition_by(df, "pk", 32).groupBy("part_id").count().collect()
    mean = 8 * 4096 / 32
    assert len(counts) == 32 and sum(r["count"] for r in counts) == 8 * 4096
    assert all(abs(r["count"] - mean) <= 0.1 * mean for r in counts)


def test_setops(spark):
    a, b = literal(spark, "x long, y long", [1], [2]), literal(spark, "y long, x long", [2], [1])
    assert [tuple(r) for r in op.concat_all(a, b).collect()] == [(1, 2), (1, 2)]
    df = literal(spark, "a long, b long", [2, 1, 1], [0, 5, 4])
    assert [tuple(r) for r in op.sort_by(df, "a", "b").collect()] == [(1, 4), (1, 5), (2, 0)]


def test_rounding(spark):
    xs = [0, 1, 2, 3, 7, 8, 9, 1023, 1025, (1 << 40) + 1]
    df = literal(spark, "x long", xs)
    got = df.select("x", round_up_multiple(F.col("x")).alias("m"), round_up_pow2(F.col("x")).alias("p")).collect()
    assert all(r.m == -(-r.x // 8) * 8 and r.p == (1 << max(0, (r.x - 1).bit_length()) if r.x > 1 else 1) for r in got)


def test_random_relation_is_reproducible(spark):
    schema = StructType([
        StructField("v", LongType(), False, {"min": 0, "max": 9}), StructField("s", StringType(), True, {"null_probability": 0.5, "min_length": 1}), StructField("d", DoubleType(), False, {"nan_probability": 0.2}),
        StructField("b", BooleanType(), False), StructField("a", ArrayType(LongType()), False), StructField("t", DateType(), False), StructField("m", DecimalType(10, 2), False),
    ])
    a, b = random_relation(spark, schema, 4, 100, 7), random_relation(spark, schema, 4, 100, 7).repartition(3)
    assert a.count() == 400 and str(sorted(map(str, a.collect()))) == str(sorted(map(str, b.collect())))
    assert {r.v for r in a.collect()} == set(range(10)) and 100 < a.filter("s is null").count() < 300


def test_benchmark_reports(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"benchmarks": [{"name": "BM/join/SF:4/x", "real_time": 1.5}, {"name": "BM/take/SF:1", "real_time": NaN}, {"name": "BM/sum", "error_occurred": true}]}')
    (src / "b.json").write_text("not json")
    (src / "c.json").write_text('{"benchmarks": [{"name": "BM/aggr/real_time:7", "real_time": 2, "label": "x"}, {"name": "BM/more/a:1/a:2", "operator": "old", "error_occurred": false}]}')
    df = read_benchmark_json(spark, str(src))
    assert df.columns == sorted(["name", "operator", "SF", "a", "label", "real_time"])
    got = {r.operator: (r.SF, r.real_time, r.label, r.a) for r in df.collect()}
    assert got == {"join": ("4", "1.5", None, None), "take": ("1", "NaN", None, None), "aggr": (None, "7", "x", None), "more": (None, None, None, "2")}
    (src / "c.json").unlink()
    df = read_benchmark_json(spark, str(src))
    assert {r.operator: (r.SF, r.real_time) for r in df.collect()} == {"join": ("4", 1.5), "take": ("1", 0.0)}
    assert read_benchmark_json(spark, str(src)).filter("false").count() == 0
    write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_streams_agree_with_the_batch(spark, tmp_path):
    spark.range(0, 4000, 1, 4).select(wang32(F.col("id")).alias("v")).write.parquet(str(tmp_path / "t"))
    batch = spark.read.parquet(str(tmp_path / "t"))
    stream = lambda: batch_stream(spark, str(tmp_path / "t"), batch.schema)
    for df, mode, name in ((streaming_filter(stream()), "append", "kept"), (streaming_sum(stream()), "complete", "total")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("kept").count() == op.filter_lt(batch).count()
    assert spark.table("total").first()[0] == op.scalar_agg(batch).first()[0]


def test_sums_beyond_63_bits(spark):
    df = literal(spark, V, [0xFFFFFFFF] * 5 + [None])
    assert int(op.sum_u32(df).first()[0]) == 5 * 0xFFFFFFFF and op.sum_u32(df.limit(0)).first()[0] is None
    # Partial sums whose total is beyond 64 bits.
    big = spark.range(0, 7, 1, 7).select(F.lit(1 << 62).alias("v"))  # a row a task
    assert int(op.sum_u32(big).first()[0]) == 7 * (1 << 62) % (1 << 64)
    most = literal(spark, "v decimal(20,0)", [Decimal((1 << 64) - 1)] * 9)
    assert int(op.sum_wrapping(most).first()[0]) == 9 * ((1 << 64) - 1) % (1 << 64)


def test_domain_check(spark):
    assert checked_u32(literal(spark, V, [0, 0xFFFFFFFF, None]), "v").count() == 3
    for bad in (-1, 1 << 32):
        with pytest.raises(Exception, match="no uint32"):
            checked_u32(literal(spark, V, [1, bad]), "v").collect()


def test_positions_over_many_ranges(spark):
    """Skewed values, strings, nulls and longs far apart, in ranges of 50 rows."""
    far = [0, 1, 2, -(1 << 63), (1 << 63) - 1, 1 << 62]
    rows = [(i, [far[i % 6], 7, 7, 7, i][i % 5], None if i % 9 == 0 else f"k{i % 40:02d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long, s string").repartition(8)
    for order in ("v", "s", "id"):
        got = dense_positions(df, order, "pos", rows_per_range=50).collect()
        assert sorted(r.pos for r in got) == list(range(3000))
        ranked = [r[order] for r in sorted(got, key=lambda r: r.pos)]
        assert ranked == sorted(ranked, key=lambda x: (x is not None, x))
    parts = df.withColumn("part", F.pmod("id", F.lit(3)))
    got = dense_positions(parts, "v", "pos", by=["part"], rows_per_range=50).collect()
    for p in range(3):
        mine = sorted((r for r in got if r.part == p), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1000)) and [r.v for r in mine] == sorted(r.v for r in mine)


def test_a_heavy_value_is_split(spark):
    df = spark.range(4000).select(F.lit(5).alias("v"), "id")
    cut = dense_positions(df, "v", "pos", rows_per_range=100)
    tasks = cut.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r.pos for r in cut.collect()) == list(range(4000)) and max(r["count"] for r in tasks) < 2000


def test_positions_with_clashing_names(spark):
    df = spark.createDataFrame([(3, 1, 2), (1, 1, 2), (2, 1, 2)], "v long, __range long, __n long")
    assert sorted((r.pos, r.v) for r in op.positions(df, "v").collect()) == [(0, 1), (1, 2), (2, 3)]
    assert op.positions(df, "v").columns == ["v", "__range", "__n", "pos"]
    assert sorted((r.batch_id, r.pos) for r in op.batch_positions(df.withColumn("batch_id", F.col("v") % 2), "v").collect()) == [(0, 0), (1, 0), (1, 1)]


def test_joins_by_groups_of_batches(spark):
    left, right = sides(spark)
    assert op.join_by_batches(left, right, factor=2).count() == 10
    assert op.join_by_batches(left, right, factor=1).count() == 8
    assert op.join_by_batches(left, right, factor=2, batches=1).count() == 0
    assert op.join_by_batches(left, right, factor=2).columns == ["fk", "v_l", "group_id", "v_r"]
    with pytest.raises(ValueError):
        op.join_by_batches(left, right, factor=0)
    assert op.noop_join(left, right).columns == op.inner_join(left, right).columns and op.noop_join(left, right).count() == 0


def test_strict_probe_and_stats(spark):
    built = literal(spark, "k long, idx long", [1, 2], [10, 20])
    probe = literal(spark, "key long, __k long", [1, 2, 2], [0, 0, 0])
    assert sorted(r.idx for r in op.hash_probe(probe, built, "key", strict=True).collect()) == [10, 20, 20]
    lost = literal(spark, "key long", [1, 3])
    assert op.hash_probe(lost, built, "key").count() == 1
    with pytest.raises(Exception, match="no match for key 3"):
        op.hash_probe(lost, built, "key", strict=True).collect()
    assert tuple(op.hash_stats(probe, "key").first()) == (3, 2, 2) and tuple(op.hash_stats(probe.limit(0), "key").first()) == (0, 0, 0)


def test_joins_with_clashing_names(spark):
    left = literal(spark, "fk long, __pk long, batch_id long", [1, 2], [5, 6], [0, 0])
    right = literal(spark, "pk long, __pk long, batch_id long", [1, 3], [7, 8], [0, 0])
    assert [tuple(r) for r in op.partition_wise_join(left, right).collect()] == [(1, 5, 0, 7)]
    assert [tuple(r) for r in op.radix_join(left.drop("batch_id"), right.drop("batch_id"), n=2).collect()] == [(1, 5, 7)]


def test_buckets_as_relations(spark):
    df = literal(spark, "pk long", range(100))
    parts = op.all_buckets(op.partition_by(df, "pk", 8), 8)
    assert len(parts) == 8 and sum(p.count() for p in parts) == 100
    assert op.one_bucket(op.partition_by(df, "pk", 8), 9).count() == 0
    assert {r.part_id for r in op.partition_by(df, "pk", 8, mix=False).collect()} == {0}  # their own top bits


def test_types_that_spark_lacks(spark):
    schema = StructType([
        StructField("d", StringType(), False, {"values": ["a", "b"]}), StructField("t", LongType(), False, {"time": 1_000_000}), StructField("f", BinaryType(), False, {"byte_width": 40}), StructField("l", ArrayType(LongType()), False, {"list_size": 3}),
        StructField("u", StructType([StructField("tag", LongType()), StructField("x", LongType()), StructField("y", StringType(), True, {"min_length": 1})]), False, {"union": True}), StructField("i", DayTimeIntervalType(), False), StructField("m", YearMonthIntervalType(), False),
    ])
    rows = random_relation(spark, schema, 2, 50).select("d", "t", "f", "l", "u", "i", F.col("m").cast("string").alias("m")).collect()
    assert {r.d for r in rows} == {"a", "b"} and all(0 <= r.t < 86_400_000_000 and len(r.f) == 40 and len(r.l) == 3 and r.i.days < 1001 and r.m for r in rows)
    assert {(r.u.tag, r.u.x is None, r.u.y is None) for r in rows} == {(0, False, True), (1, True, False)} and len({bytes(r.f) for r in rows}) == 100


def test_generators(spark):
    idx = take_indices(spark, 3, 20, 100).collect()
    assert len(idx) == 60 and {r.batch_id for r in idx} == {0, 1, 2} and all(0 <= r.i < 100 for r in idx)
    left, right = join_sides(spark, 4, 50)
    assert op.inner_join(left.drop("batch_id"), right.drop("batch_id")).count() == 200 and left.filter("fk div 50 <> batch_id or x > 65535").count() == 0
    assert dense_index(spark, 4, 50, parallel=False).rdd.getNumPartitions() == 1


def test_run_line(spark, tmp_path):
    line = run_line(spark, lambda: dense_index(spark, 2, 10), 1, 2, 10)
    assert line.columns == "SF,Batches,Batch-Size,Results,Real-Time(ms),CPU-Time(ms),Memory(KiB)".split(",") and tuple(line.first())[:4] == (1, 2, 10, 20)
    write_csv(line, str(tmp_path / "line"))


def test_minimum(spark):
    df = literal(spark, "a long, b long", [1, 5, None], [2, 3, 4])
    assert [r[0] for r in df.select(minimum(F.col("a"), F.col("b"))).collect()] == [1, 3, None]


def test_entry_without_the_subpackage(tmp_path):
    """A copy without the training-data operators imports; a fault inside them is not hidden."""
    root = Path(__file__).resolve().parent.parent
    for name in ("whole", "without", "broken"):
        shutil.copytree(root / "quern", tmp_path / name / "quern", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if name == "without" else [])))
        shutil.copy(root / "__spark_entry__.py", tmp_path / name)
    names = lambda d: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path / d, capture_output=True, text=True)
    assert int(names("without").stdout) == len(catalogue.QUERIES) and names("without").returncode == 0
    if (root / "corpus_pipeline.py").exists() and (root / "quern/llm").exists():
        for d in ("whole", "broken"):
            shutil.copy(root / "corpus_pipeline.py", tmp_path / d)
        (tmp_path / "broken/quern/llm/queries.py").write_text("import no_such_module_anywhere\n")
        assert int(names("whole").stdout) == len(catalogue.QUERIES) + 11 and names("broken").returncode != 0
