"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table
from quern.llm.decontaminate import leaks
from quern.llm.exact_dedup import exact_groups
from quern.llm.license_scan import scan_licenses
from quern.llm.minhash_dedup import near_components
from quern.llm.packing import pack
from quern.llm.pii import find_pii
from quern.llm.quality import score_quality
from quern.llm.toxicity import score_toxicity
from quern.llm.url_filter import url_verdicts
from quern.llm.warc import derivatives, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    r"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT DISTINCT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
    m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
)
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=4)


#: Fixed values. The verdicts, hosts and paths of the URL rules, and the hosts of the method's own list.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BLOCKED_HOSTS = ["ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "free-bets.example.com", "spam-farm.example.com"]


@query(
    r"""
    WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
    r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, rhost, rpath)),
    m AS (SELECT page_id, max({'n': length(rhost || rpath), 'verdict': verdict, 'rule': rhost || rpath}) AS best FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
    b AS (SELECT * FROM (VALUES ('ads-track.example.com'), ('adult-x.example.net'), ('casino-win.example.com'), ('free-bets.example.com'), ('spam-farm.example.com')) v(bad))
    SELECT p.page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE host = bad OR ends_with(host, '.' || bad)) THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN m ON p.page_id = m.page_id"""
)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "key string")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, blocked).select("page_id", "host", "path", "rule", "verdict")


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
    i AS (SELECT *, len(ws) AS n, least(5, len(ws)) AS k FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) > 0),
    ic AS (SELECT item_id, n, k, g, count(*) AS c FROM (SELECT item_id, n, k, unnest(list_transform(range(1, n - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS g FROM i) GROUP BY ALL),
    dg AS (SELECT doc_id, k, len(ws) AS size, unnest(range(0, len(ws) - k + 1)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM i)),
    hit AS (SELECT doc_id, size, item_id, n, k, p, g, c, least(n, size) - k + 1 AS m FROM dg JOIN ic USING (k, g)),
    win AS (SELECT *, unnest(range(greatest(0, p - m + 1), least(p, greatest(size - n, 0)) + 1)) AS start FROM hit),
    cnt AS (SELECT doc_id, item_id, n, k, m, start, g, least(count(*), any_value(c)) AS c FROM win GROUP BY doc_id, item_id, n, k, m, start, g),
    sim AS (SELECT doc_id, item_id, n, k, m, start, CAST(sum(c) AS BIGINT) AS shared FROM cnt GROUP BY ALL)
    SELECT doc_id, item_id, start AS start_word, m + k - 1 AS n_words, shared / (m + n - k + 1 - shared) AS similarity FROM sim WHERE 100 * shared >= 80 * (m + n - k + 1 - shared)
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (m + n - k + 1 - shared) DESC, start) = 1"""
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query()
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
