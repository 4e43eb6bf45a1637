"""URL filters with redirect equivalence.

Pages that redirect or point by a canonical link to each other form classes,
found as connected components over all edges. A url's own longest rule decides
it; a url without a rule takes the decision of its class: allow if any alias is
explicitly allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .graph import connected_components
from .store import Store, join_by_size

#: Host and path of each rule; the path starts at the first slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of tags and of what they say; tags and attributes may be in capitals, in any order, and have either quotes or none.
TAG = r"(?i)<(?:link|meta)[ \t\r\n\f][^>]*>"
CANONICAL = r"""(?i)^<link[^>]*[ \t\r\n\f]rel[ \t\r\n\f]*=[ \t\r\n\f]*(?:"(?:[^"]*[ \t\r\n\f])?canonical(?:[ \t\r\n\f][^"]*)?"|'(?:[^']*[ \t\r\n\f])?canonical(?:[ \t\r\n\f][^']*)?'|canonical[ \t\r\n\f/>])"""
REFRESH = r"""(?i)^<meta[^>]*[ \t\r\n\f]http-equiv[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*refresh["' \t\r\n\f/>]"""
VALUE = r"""(?i)[ \t\r\n\f]{}[ \t\r\n\f]*=[ \t\r\n\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n\f"'>]+))"""
TARGET = r"""(?i)^[ \t\r\n\f0-9.]*[;, \t\r\n\f]*url[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*([^"']*)"""
ORIGIN = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
#: Bytes of alias nodes up to which they are sent to all tasks; beyond, they are joined by shuffle.
SENT = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, both empty where the url is null or lacks ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _CAPITALS, _SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does; of equally long ones the first by text."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one wraps the others, so the longest is asked first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(F.lit(None) if rule is None else rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(F.lit(None) if verdict is None else verdict)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def node_of(url: Column) -> Column:
    """The url without fragment, its scheme and host in small letters; null where it has none."""
    whole = F.split_part(url, F.lit("#"), F.lit(1))
    origin = F.regexp_extract(whole, ORIGIN, 0)
    return F.when(F.length(origin) > 0, F.concat(F.translate(origin, _CAPITALS, _SMALL), F.substring(whole, F.length(origin) + 1, F.length(whole))))


def resolved(base: Column, target: Column) -> Column:
    """The absolute url that ``target`` means on the page ``base`` (a node), null where that is no url of a host."""
    target = F.trim(F.replace(F.split_part(target, F.lit("#"), F.lit(1)), F.lit("&amp;"), F.lit("&")))
    origin = F.regexp_extract(base, ORIGIN, 0)
    plain, before = F.split_part(base, F.lit("?"), F.lit(1)), F.split_part(target, F.lit("?"), F.lit(1))
    folder = F.regexp_extract(F.substring(plain, F.length(origin) + 1, F.length(plain)), "(?s)^.*/", 0)
    path = F.concat(F.when(target.startswith("/") | (folder == ""), "/").otherwise(folder), F.regexp_replace(before, "^/", ""))
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    ends = F.when(path.rlike("/[.][.]?$"), "/").otherwise("")
    query = F.substring(target, F.length(before) + 1, F.length(target))
    return (
        F.when(target == "", None)
        .when(target.rlike(ORIGIN), target)
        .when(target.startswith("//"), F.concat(F.split_part(base, F.lit("/"), F.lit(1)), target))
        .when(target.startswith("?"), F.concat(plain, target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(origin, F.array_join(steps, "/"), ends, query))
    )


def _value(tag: Column, name: str) -> Column:
    pattern = VALUE.format(name)
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and the node that any of its canonical links or refreshes names, resolved against the page's url."""
    tags = pages.select(node_of(F.col("url")).alias("a"), F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    named = F.when(F.col("tag").rlike(CANONICAL), _value(F.col("tag"), "href")).when(F.col("tag").rlike(REFRESH), F.regexp_extract(_value(F.col("tag"), "content"), TARGET, 1))
    found = tags.where(F.col("a").isNotNull()).select("a", named.alias("to")).where("to is not null")
    return found.select("a", node_of(resolved(F.col("a"), F.col("to"))).alias("b")).where(F.col("b").isNotNull() & (F.col("a") != F.col("b")))


def judge(pages: DataFrame, edges: DataFrame, store: Store, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url).

    ``edges`` (a, b) joins nodes, urls without fragments; nodes that no page has still
    pass decisions on. Null urls and urls without ``://`` have no host, no path, no
    rule and no alias, and are allowed. Repeated pages get a row each.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "own": verdict})
    classes = store.keep(connected_components(edges, store), "classes")
    alias_host, alias_path = host_and_path(F.col("id"))
    alias = classes.withColumns({"h": alias_host, "p": alias_path})
    decided = alias.withColumn("own", longest_rule(F.col("h"), F.col("p"), rules)[1]).groupBy("root").agg(
        F.when(F.bool_or(F.col("own") == "allow"), "allow").when(F.bool_or(F.col("own") == "block"), "block").otherwise("allow").alias("passed"), F.count("*").alias("n")
    )
    by_node = join_by_size(classes, decided, ["root"], "n", classes.count()).select(F.col("id").alias("node"), "passed")
    final = F.coalesce("own", "passed", F.lit("allow")).alias("verdict")
    if by_node.agg(F.coalesce(F.sum(F.octet_length("node") + 16), F.lit(0))).first()[0] <= SENT:
        return judged.join(F.broadcast(by_node), "node", "left").select("page_id", "host", "path", "rule", final)
    some = judged.where(F.col("node").isNotNull())
    known = some.groupBy("node").agg(F.count("*").alias("n")).join(by_node, "node", "left")
    joined = join_by_size(some, known, ["node"], "n", some.count())
    return joined.unionByName(judged.where(F.col("node").isNull()).withColumns({"n": F.lit(1).cast("long"), "passed": F.lit(None).cast("string")})).select("page_id", "host", "path", "rule", final)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url"), page_edges(pages), Store(spark))


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{_CAPITALS}', '{_SMALL}')"


def _sql_path(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"regexp_extract(substr({rest}, length(regexp_extract({rest}, '^[^/?#]*')) + 1), '^[^?#]*')"


def _sql_rule(pick: int, rules=RULES) -> str:
    cases = []
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        cases.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}') THEN '{(kind, text)[pick]}'")
    return f"CASE {' '.join(cases)} END"


def _sql_node(url: str) -> str:
    origin = f"regexp_extract({url}, '{ORIGIN}')"
    return f"CASE WHEN {origin} <> '' THEN translate({origin}, '{_CAPITALS}', '{_SMALL}') || substr(split_part({url}, '#', 1), length({origin}) + 1) END"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_value(name: str) -> str:
    return " || ".join(f"regexp_extract(tag, {_sql_text(VALUE.format(name))}, {k})" for k in (1, 2, 3))


ORACLE = f"""
WITH RECURSIVE judged AS (
  SELECT *, {_sql_rule(1)} AS rule, {_sql_rule(0)} AS own FROM (
    SELECT page_id, {_sql_node('url')} AS node, coalesce({_sql_host('url')}, '') AS host, coalesce({_sql_path('url')}, '') AS path FROM pages)
), tags AS (
  SELECT {_sql_node('url')} AS a, unnest(regexp_extract_all(html, {_sql_text(TAG)})) AS tag FROM pages
), named AS (
  SELECT a, regexp_extract(a, '{ORIGIN}') AS origin, split_part(a, '?', 1) AS bare, trim(replace(split_part("to", '#', 1), '&amp;', '&'), ' ') AS t FROM (
    SELECT a, CASE WHEN regexp_matches(tag, {_sql_text(CANONICAL)}) THEN {_sql_value('href')}
      WHEN regexp_matches(tag, {_sql_text(REFRESH)}) THEN regexp_extract({_sql_value('content')}, {_sql_text(TARGET)}, 1) END AS "to" FROM tags)
  WHERE a IS NOT NULL AND "to" IS NOT NULL
), whole AS (
  SELECT *, CASE WHEN t LIKE '/%' THEN split_part(t, '?', 1) WHEN folder = '' THEN '/' || split_part(t, '?', 1) ELSE folder || split_part(t, '?', 1) END AS way
  FROM (SELECT *, regexp_extract(substr(bare, length(origin) + 1), '(?s)^.*/') AS folder FROM named)
), resolved AS (
  SELECT a, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '{ORIGIN}') THEN t WHEN t LIKE '//%' THEN split_part(a, '/', 1) || t
    WHEN t LIKE '?%' THEN bare || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE origin || array_to_string(list_reduce(string_split(way, '/'), lambda done, s: CASE WHEN s = '..' THEN list_slice(done, 1, greatest(1, len(done) - 1)) WHEN s = '.' THEN done ELSE list_append(done, s) END, CAST([] AS VARCHAR[])), '/')
      || CASE WHEN way LIKE '%/.' OR way LIKE '%/..' THEN '/' ELSE '' END || CASE WHEN contains(t, '?') THEN substr(t, strpos(t, '?')) ELSE '' END END AS url FROM whole
), edges AS (
  SELECT a, b FROM (SELECT a, {_sql_node('url')} AS b FROM resolved WHERE url IS NOT NULL) WHERE b IS NOT NULL AND a <> b
), pairs AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a
), passed AS (
  SELECT a, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' ELSE 'allow' END AS passed
  FROM (SELECT a, {_sql_rule(0)} AS own FROM (SELECT a, {_sql_host('b')} AS host, {_sql_path('b')} AS path FROM reach)) GROUP BY a
)
SELECT page_id, host, path, rule, coalesce(own, passed, 'allow') AS verdict FROM judged LEFT JOIN passed ON node = a
"""
