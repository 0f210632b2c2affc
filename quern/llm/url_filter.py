"""URL rules by Bloom filter cascades, in DataFrame operations alone.

A cascade answers membership of a key in a list exactly, for every key that the
corpus holds. Level 1 is a Bloom filter of the listed keys that the corpus has;
level 2 one of those other corpus keys that level 1 takes for listed ones; level 3
of the listed keys that level 2 wrongly rules out; and so on until a level has no
false positive. A page's verdict then needs hashing only: no join at any number of
rules. Level 1 is sized from the key counts, so that its false positives are about
as many as listed keys; a cascade takes O(listed * log(corpus / listed)) bits.

The corpus is read twice: once for its distinct keys, on which all levels are
built, and once for the verdicts. What is gathered and shipped with the plan are
the filters' bits, as binary literals of at most ``max_bytes`` a cascade; a list
that would need more is looked up by an exact join of distinct keys instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_name, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4


def _places(key: Column, level: int, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)])


class _Level:
    """One Bloom filter: its bits as a binary literal."""

    def __init__(self, keys: DataFrame, level: int, bits: int):
        self.level, self.bits = level, bits
        at = keys.select(F.explode(_places(F.col("key"), level, bits)).alias("at"))
        byte = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("x"))
        data = bytearray(-(-bits // 8))
        for r in byte.toLocalIterator():
            data[r["byte"]] = r["x"]
        self.data = F.lit(bytes(data))

    def might_have(self, key: Column) -> Column:
        def bit(at: Column) -> Column:
            byte = F.conv(F.hex(F.call_function("substring", self.data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return F.forall(_places(key, self.level, self.bits), bit)


class Cascade:
    """Exact membership of ``listed`` among the keys of ``universe`` (both a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bytes: int = 1 << 26):
        universe = universe.select("key").filter("key is not null").distinct()
        self.present = saved(listed.select("key").distinct().join(universe, "key", "left_semi"))
        self.levels: list[_Level] = []
        wanted, count, total = self.present, self.present.count(), universe.count()
        if not count:
            return
        first_bits = max(8, round(1.44 * max(2, total // count).bit_length()))
        #: Too large for literals: levels after the first are together smaller than two of 8 bits a key.
        self.too_large = count * (first_bits + 16) > 8 * max_bytes
        other = None
        while count and not self.too_large and len(self.levels) < 64:
            level = _Level(wanted, len(self.levels), max(64, count * (8 if self.levels else first_bits)))
            self.levels.append(level)
            rest = universe.join(self.present, "key", "left_anti") if other is None else other
            wanted, other = saved(rest.filter(level.might_have(F.col("key")))), wanted
            count = wanted.count()
        if count and not self.too_large:
            raise RuntimeError("the cascade's filters did not separate the keys")

    too_large = False

    def has(self, key: Column) -> Column:
        """True if listed; defined for the keys of the universe."""
        out = F.lit(bool(len(self.levels) % 2))
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].might_have(key), out).otherwise(F.lit(i % 2 == 1))
        return out

    def with_members(self, df: DataFrame, keys: str, out: str) -> DataFrame:
        """``df`` with ``out``, those of the array ``keys`` that are listed."""
        if not self.too_large:
            return df.withColumn(out, F.filter(keys, self.has))
        a, key = free_name(df, "__keys"), F.explode("keys").alias("key")
        found = df.select(F.col(keys).alias("keys")).distinct().select("keys", key).join(self.present, "key").groupBy("keys").agg(F.collect_set("key").alias(out))
        found = found.withColumnRenamed("keys", a)
        return df.join(found, F.col(keys) == F.col(a), "left").drop(a).withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of an URL; both empty without ``://``. Only A-Z are lower-cased."""
    at = F.call_function("locate", F.lit("://"), url)
    rest = F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.call_function("substring", rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], blocked_hosts: DataFrame, url_column: str = "url", max_bytes: int = 1 << 26) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains when
    the URL's path starts with the rule's; the longest wins (block, if both lists
    have it). Without a rule, a page whose host or parent domain is in
    ``blocked_hosts`` (a column ``key``; nulls there count for nothing) is blocked,
    any other allowed.

    A null URL or one without ``://`` has an empty host and path, no rule, and is
    allowed. Repeated rows each get the same verdict; an empty table gives an
    empty result. Columns of ``pages`` named like the result's are replaced, all
    others are kept, whatever their names.
    """
    spark = pages.sparkSession
    names = ("__host", "__path", "__rules", "__hosts", "__allow", "__block", "__bad", "__best")
    host_c, path_c, rules_c, hosts_c, allow_c, block_c, bad_c, best_c = temporary = [free_name(pages, n) for n in names]
    sizes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    host, path = split_url(F.col(url_column))
    split = pages.withColumn(host_c, F.coalesce(host, F.lit(""))).withColumn(path_c, F.coalesce(path, F.lit("")))
    none = F.array().cast("array<string>")
    rule_keys = F.array_distinct(F.array(*[F.concat(F.substring_index(host_c, ".", -k), F.substring(F.col(path_c), 1, n)) for k, n in sizes])) if sizes else none
    blocked_hosts = blocked_hosts.select("key").filter("key is not null")
    labels = sorted(r[0] for r in blocked_hosts.select(F.size(F.split("key", r"\."))).distinct().collect())  # counts of labels, a few
    host_keys = F.array_distinct(F.array(*[F.substring_index(host_c, ".", -k) for k in labels])) if labels else none
    keyed = split.withColumn(rules_c, rule_keys).withColumn(hosts_c, host_keys)

    of = lambda column, kind: F.transform(column, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    universe = saved(keyed.select(F.explode(F.concat(of(rules_c, 0), of(hosts_c, 1))).alias("k")).select("k.kind", "k.key").distinct())
    of_rules, of_hosts = universe.filter("kind = 0"), universe.filter("kind = 1")
    listed = lambda verdict: spark.createDataFrame([(h + p,) for v, h, p in rules if v == verdict], "key string")
    out = Cascade(listed("allow"), of_rules, max_bytes).with_members(keyed, rules_c, allow_c)
    out = Cascade(listed("block"), of_rules, max_bytes).with_members(out, rules_c, block_c)
    out = Cascade(blocked_hosts, of_hosts, max_bytes).with_members(out, hosts_c, bad_c)

    found = lambda column, verdict: F.transform(column, lambda k: F.struct(F.length(k).alias("n"), F.lit(verdict).alias("verdict"), k.alias("rule")))
    out = out.withColumn(best_c, F.array_max(F.concat(found(allow_c, "allow"), found(block_c, "block"))))
    method = F.when(F.size(bad_c) > 0, F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumns({"host": F.col(host_c), "path": F.col(path_c), "rule": F.col(best_c)["rule"], "verdict": F.coalesce(F.col(best_c)["verdict"], method)})
    return out.drop(*temporary)
