"""Deterministic relations: the same rows whatever the number of tasks.

Random columns hash the row's index instead of calling ``rand``: a recomputed
partition then gives the same rows, and no state is carried between batches.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DayTimeIntervalType, StructType, YearMonthIntervalType

from quern.functions.hashing import wang32
from quern.types import U32_MASK


def dense_index(spark: SparkSession, num_batches: int, batch_size: int, name: str = "pk", partitions: int | None = None, parallel: bool = True) -> DataFrame:
    """0..N-1 in ``name`` and the batch of each row in ``batch_id``; one task makes all if not ``parallel``."""
    return spark.range(0, num_batches * batch_size, 1, partitions if parallel else 1).select((F.col("id") / batch_size).cast("long").alias("batch_id"), F.col("id").alias(name))


def random_u32(index: Column, seed: int = 42, low: int = 0, high: int = U32_MASK) -> Column:
    """A uniform value in low..high (both included) drawn from ``index`` and ``seed``."""
    if not 0 <= low <= high <= U32_MASK:
        raise ValueError("need 0 <= low <= high < 2^32")
    return F.pmod(F.xxhash64(index, F.lit(seed)), F.lit(high - low + 1)) + F.lit(low)


def fk_batch_local(batch_id: Column, index: Column, pk_batch_size: int) -> Column:
    """A foreign key of the batch's own range of primary keys."""
    return batch_id * F.lit(pk_batch_size) + F.pmod(wang32(index), F.lit(pk_batch_size))


def take_indices(spark: SparkSession, num_batches: int, per_batch: int, batch_size: int, seed: int = 42) -> DataFrame:
    """(batch_id, n, i): ``per_batch`` indices into each batch of ``batch_size`` rows, with replacement."""
    rows = spark.range(0, num_batches * per_batch).select((F.col("id") / per_batch).cast("long").alias("batch_id"), (F.col("id") % per_batch).alias("n"), "id")
    return rows.select("batch_id", "n", random_u32(F.col("id"), seed, 0, batch_size - 1).alias("i"))


def join_sides(spark: SparkSession, num_batches: int, batch_size: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(batch_id, fk, x) and (batch_id, pk, y): foreign keys of the batch's own primary keys, payloads below 2^16."""
    right = dense_index(spark, num_batches, batch_size)
    payload = lambda k: random_u32(F.col("pk"), seed + k, 0, 0xFFFF)
    left = right.select("batch_id", fk_batch_local(F.col("batch_id"), F.col("pk"), batch_size).alias("fk"), payload(1).alias("x"))
    return left, right.select("batch_id", "pk", payload(2).alias("y"))


def literal(spark: SparkSession, schema: StructType | str, *columns: Sequence) -> DataFrame:
    """A relation of given columns."""
    if len({len(c) for c in columns}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema)


def _column(kind: DataType, i: Column, seed: int, meta: dict) -> Column:
    """A value of a field's type. Metadata: min, max, min_length, max_length,
    true_probability, nan_probability; and for types that Spark lacks ``values`` (a
    dictionary's), ``time`` (units a second: a LONG within the day), ``byte_width``
    (fixed-size binary), ``list_size`` (fixed-size list) and ``union`` (a struct whose
    first field tells which of the others, the only one not null, holds the value)."""
    name = kind.typeName()
    h = F.xxhash64(i, F.lit(seed))
    unit = F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))
    if "values" in meta:
        return F.get(F.array(*[F.lit(v) for v in meta["values"]]), F.pmod(h, F.lit(len(meta["values"]))).cast("int")).cast(kind)
    if "time" in meta:
        return F.pmod(h, F.lit(86_400 * int(meta["time"]))).cast(kind)
    if "byte_width" in meta:
        width = int(meta["byte_width"])
        return F.substring(F.unhex(F.concat(*[F.sha2(F.concat_ws(" ", i, F.lit(seed), F.lit(k)), 256) for k in range(-(-width // 32) or 1)])), 1, width)
    if isinstance(kind, DayTimeIntervalType):
        return F.make_dt_interval(F.pmod(h, F.lit(1000)).cast("int"), F.lit(0), F.lit(0), F.pmod(h, F.lit(86_400))).cast(kind)
    if isinstance(kind, YearMonthIntervalType):
        return F.make_ym_interval(F.pmod(h, F.lit(100)).cast("int"), F.pmod(h, F.lit(12)).cast("int")).cast(kind)
    if name == "void":
        return F.lit(None)
    if name == "boolean":
        return unit < F.lit(float(meta.get("true_probability", 0.5)))
    if name in ("byte", "short", "integer", "long"):
        bits = {"byte": 8, "short": 16, "integer": 32, "long": 62}[name]
        low, high = int(meta.get("min", -(1 << bits - 1))), int(meta.get("max", (1 << bits - 1) - 1))
        return (F.pmod(h, F.lit(high - low + 1)) + F.lit(low)).cast(kind)
    if name in ("float", "double"):
        low, high = float(meta.get("min", 0.0)), float(meta.get("max", 1.0))
        value = F.lit(low) + unit * F.lit(high - low)
        odd = F.pmod(F.xxhash64(i, F.lit(seed), F.lit("nan")), F.lit(1 << 20)) < F.lit(int(float(meta.get("nan_probability", 0)) * (1 << 20)))
        return F.when(odd, F.lit(float("nan"))).otherwise(value).cast(kind)
    if name == "decimal":
        return (F.pmod(h, F.lit(10 ** min(kind.precision, 18))).cast("decimal(38,0)") / F.lit(10**kind.scale)).cast(kind)
    if name in ("string", "binary"):
        low, high = int(meta.get("min_length", 0)), int(meta.get("max_length", 20))
        size = (F.pmod(h, F.lit(high - low + 1)) + F.lit(low)).cast("int")
        text = F.substring(F.repeat(F.regexp_replace(F.base64(F.sha2(i.cast("string"), 256).cast("binary")), "[^A-Za-z]", ""), 1 + high // 40), F.lit(1), size)
        return text.cast(kind)
    if name == "date":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(h, F.lit(36_500)).cast("int"))
    if name in ("timestamp", "timestamp_ntz"):
        return F.timestamp_micros(F.pmod(h, F.lit(4 * 10**15))).cast(kind)
    if name == "array" and "list_size" in meta:
        return F.transform(F.sequence(F.lit(1), F.lit(int(meta["list_size"]))), lambda k: _column(kind.elementType, i * 31 + k, seed + 1, {})) if int(meta["list_size"]) else F.array().cast(kind)
    if name == "array":
        size = F.pmod(h, F.lit(int(meta.get("max_length", 4)) + 1)).cast("int")
        return F.transform(F.slice(F.array(*[F.lit(k) for k in range(int(meta.get("max_length", 4)) or 1)]), F.lit(1), size), lambda k: _column(kind.elementType, i * 31 + k, seed + 1, {}))
    if name == "struct" and meta.get("union"):
        tag, *fields = kind.fields
        which = F.pmod(h, F.lit(len(fields))).cast(tag.dataType)
        return F.struct(which.alias(tag.name), *[F.when(which == k, _column(f.dataType, i, seed + 1 + k, f.metadata or {})).alias(f.name) for k, f in enumerate(fields)])
    if name == "struct":
        return F.struct(*[_column(f.dataType, i, seed + 1 + k, f.metadata or {}).alias(f.name) for k, f in enumerate(kind.fields)])
    if name == "map":
        return F.map_from_arrays(F.array(_column(kind.keyType, i, seed + 1, {})), F.array(_column(kind.valueType, i, seed + 2, {})))
    raise NotImplementedError(f"no generator for {name}")


def random_relation(spark: SparkSession, schema: StructType, num_batches: int, batch_size: int, seed: int = 42) -> DataFrame:
    """``num_batches * batch_size`` rows of ``schema`` with ``batch_id`` and ``pos``.

    Nullable fields are null with metadata ``null_probability``, 0.01 by default.
    """
    i = F.col("id")
    out = [(i / batch_size).cast("long").alias("batch_id"), (i % batch_size).alias("pos")]
    for k, f in enumerate(schema.fields):
        meta, s = f.metadata or {}, seed * 1000 + k * 10
        p = float(meta.get("null_probability", 0.01 if f.nullable else 0))
        value = _column(f.dataType, i, s, meta)
        if p:
            value = F.when(F.pmod(F.xxhash64(i, F.lit(s), F.lit("null")), F.lit(1 << 20)) >= F.lit(int(p * (1 << 20))), value)
        out.append(value.alias(f.name))
    return spark.range(0, num_batches * batch_size).select(*out)
