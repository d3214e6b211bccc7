"""Structure: counts, resolution, range joins, snapshots, deltas, graph walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as tx
from skarn.operators import graph, packing, structure
from skarn.queries import query, table
from skarn.sources import diffs


@query(
    """
SELECT o_orderkey, coalesce(sum((l_returnflag = 'A')::INT), 0)::BIGINT AS functions, coalesce(sum((l_returnflag IN ('N'))::INT), 0)::BIGINT AS classes, coalesce(sum((l_returnflag = 'R')::INT), 0)::BIGINT AS others, count(l_orderkey)::BIGINT AS total
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""
)
def file_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "function").when(F.col("l_returnflag") == "N", "class").otherwise("other")
    symbols = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("kind"))
    return structure.file_counts(table(spark, sf_dir, "orders").select("o_orderkey"), symbols, "o_orderkey")


@query(
    """
SELECT lang AS language, count(*) AS eligible, sum((toxic IS NULL OR toxic = 0)::INT)::BIGINT AS parsed, sum((toxic = 1)::INT)::BIGINT AS failed, sum(CASE WHEN toxic IS NULL OR toxic = 0 THEN n_chars ELSE 0 END)::BIGINT AS symbols
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""".replace("sum((toxic = 1)::INT)", "coalesce(sum((toxic = 1)::INT), 0)")
)
def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return structure.coverage(d.select(F.col("lang").alias("language"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("has_error"), F.col("n_chars").alias("symbols")))


@query("SELECT p_name AS name, count(*) AS n_refs, count(DISTINCT p_partkey) AS n_defs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    named = by_part.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey")
    return named.groupBy("name").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_defs"))


@query(
    """
WITH r AS (SELECT p_name AS name, count(*) AS n_refs, count(DISTINCT p_partkey) AS n_defs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name)
SELECT name, round(greatest(0.001, (CASE WHEN length(name) >= 8 THEN 10.0 ELSE 1.0 END) * (CASE WHEN starts_with(name, '_') THEN 0.1 ELSE 1.0 END) * (CASE WHEN n_defs > 5 THEN 0.1 ELSE 1.0 END) * sqrt(n_refs::DOUBLE)), 6) AS weight FROM r
"""
)
def symbol_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("name", F.round(structure.symbol_weight(F.col("name"), F.col("n_refs"), F.col("n_defs")), 6).alias("weight"))


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


_HREFS = "SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS h FROM pages)"


@query(f"SELECT href, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS k FROM ({_HREFS})) WHERE k = 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.first_wins(_hrefs(spark, sf_dir), ["href"], "page_id", "pos").select("href", "page_id", F.col("pos").cast("long").alias("pos"))


@query(f"SELECT href, count(*) AS n, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS importers FROM (SELECT DISTINCT href, page_id FROM ({_HREFS})) GROUP BY href")
def importers_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hrefs(spark, sf_dir).select("href", "page_id").distinct()
    ids = F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string"))
    return d.groupBy("href").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("importers"))


@query(
    """
WITH calls AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer),
tiers AS (
  SELECT c_custkey, s_suppkey AS target, 1 AS tier FROM calls JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 9000
  UNION ALL SELECT c_custkey, s_suppkey, 2 FROM calls JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey AND s_acctbal > 9000
  UNION ALL SELECT c_custkey, s_suppkey, 3 FROM calls, (SELECT min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 9000)
), ranked AS (SELECT *, dense_rank() OVER (PARTITION BY c_custkey ORDER BY tier) AS k FROM tiers WHERE target IS NOT NULL)
SELECT calls.c_custkey, tier, target FROM calls LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (c_custkey)
"""
)
def call_resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to rich suppliers: of the nation, else of the region, else the first anywhere; all ties kept."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    calls = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lit(0).alias("all")).join(F.broadcast(nation), "c_nationkey", "left")
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("c_nationkey"))
    by_region = rich.join(F.broadcast(nation), "c_nationkey").select("target", "n_regionkey")
    anywhere = rich.agg(F.min("target").alias("target")).withColumn("all", F.lit(0))
    # few nations have many customers each: sent to all, the suppliers leave the customers where they lie
    return structure.resolve_by_priority(calls, [("c_nationkey", F.broadcast(rich)), ("n_regionkey", F.broadcast(by_region)), ("all", F.broadcast(anywhere))], "c_custkey")


_DAY = "(epoch(o_orderdate) // 86400)::BIGINT"


@query(
    f"""
WITH i AS (SELECT o_custkey, o_orderkey, {_DAY} AS s, {_DAY} + 30 + o_orderkey % 60 AS e FROM orders),
p AS (SELECT o_custkey, o_orderkey AS point, {_DAY} + 7 AS at_ FROM orders)
SELECT point, o_orderkey FROM (SELECT point, i.o_orderkey, row_number() OVER (PARTITION BY point ORDER BY e - s, i.o_orderkey) AS k FROM p JOIN i USING (o_custkey) WHERE s <= at_ AND at_ <= e) WHERE k = 1
"""
)
def owning_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("s", F.unix_date(F.to_date("o_orderdate")).cast("long"))
    intervals = o.select("o_custkey", "o_orderkey", "s", (F.col("s") + 30 + F.col("o_orderkey") % 60).alias("e"))
    points = o.select("o_custkey", F.col("o_orderkey").alias("point"), (F.col("s") + 7).alias("at_"))
    return structure.owning_interval(points, intervals, "o_custkey", "at_", "s", "e", "point", "o_orderkey")


@query(
    f"""
WITH i AS (SELECT o_custkey, o_orderkey, {_DAY} AS s, {_DAY} + 5 AS e FROM orders WHERE o_orderstatus <> 'O'),
h AS (SELECT o_custkey, {_DAY} AS hs, {_DAY} + 20 AS he FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey FROM i WHERE EXISTS (SELECT 1 FROM h WHERE h.o_custkey = i.o_custkey AND s <= he AND e >= hs)
"""
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("s", F.unix_date(F.to_date("o_orderdate")).cast("long"))
    spans = o.filter("o_orderstatus <> 'O'").select("o_custkey", "o_orderkey", "s", (F.col("s") + 5).alias("e"))
    hunks = o.filter("o_orderstatus = 'O'").select("o_custkey", F.col("s").alias("hs"), (F.col("s") + 20).alias("he"))
    return structure.overlapping(spans, hunks, "o_custkey", "o_orderkey", "s", "e", "hs", "he")


_SNAPSHOTS = """
WITH p AS (SELECT doc_id AS path, n_chars AS size, doc_id * 10 AS mtime FROM documents WHERE lang <> 'es'),
d AS (SELECT doc_id AS path, n_chars + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS size, doc_id * 10 + (CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) AS mtime FROM documents WHERE lang <> 'de')
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 10).alias("mtime"), "lang")
    later = d.filter("lang <> 'de'").drop("lang").withColumns({"size": F.col("size") + F.when(F.col("path") % 5 == 0, 1).otherwise(0), "mtime": F.col("mtime") + F.when(F.col("path") % 11 == 0, 1).otherwise(0)})
    return d.filter("lang <> 'es'").drop("lang"), later


@query(_SNAPSHOTS + "SELECT path, CASE WHEN p.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed' WHEN p.size = d.size AND p.mtime = d.mtime THEN 'unchanged' ELSE 'changed' END AS change FROM p FULL JOIN d USING (path)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.manifest_diff(*_snapshots(spark, sf_dir))


@query(_SNAPSHOTS + "SELECT coalesce(d.path, p.path) AS path, coalesce(d.size, p.size) AS size, coalesce(d.mtime, p.mtime) AS mtime FROM p FULL JOIN d USING (path) WHERE d.path IS NOT NULL")
def apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous snapshot with the difference to the later one applied: the later one."""
    p, d = _snapshots(spark, sf_dir)
    diff = structure.manifest_diff(p, d)
    upserts = d.join(diff.filter("change IN ('added', 'changed')"), "path", "left_semi")
    return structure.apply_delta(p, upserts, diff.filter("change = 'removed'"), "path")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM (SELECT doc_id, sha256(text) AS h FROM documents) WHERE (doc_id, h) NOT IN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE sha256(text) END FROM documents WHERE lang <> 'fr')")
def changed_hash_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    stored = now.filter("lang <> 'fr'").withColumn("content_hash", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("content_hash")))
    return now.join(stored, ["doc_id", "content_hash"], "left_anti").select("doc_id")


_PRECISE = "SELECT DISTINCT l_orderkey, l_partkey, 'scip' AS source FROM lineitem WHERE l_linenumber = 1"


@query(f"WITH p AS ({_PRECISE}) SELECT l_orderkey, l_partkey, 'heuristic' AS source FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM p) UNION ALL SELECT * FROM p")
def override_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.select("l_orderkey", "l_partkey").distinct().withColumn("source", F.lit("heuristic"))
    precise = line.filter("l_linenumber = 1").select("l_orderkey", "l_partkey").distinct().withColumn("source", F.lit("scip"))
    return structure.override(rows, precise, ["l_orderkey", "l_partkey"])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call customers, customers extend nations, nations declare regions."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (
        o.select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"), F.lit("calls").alias("relation"), F.lit(1.0).alias("weight"))
        .unionByName(c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("extends").alias("relation"), F.lit(2.0).alias("weight")))
        .unionByName(n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("declares").alias("relation"), F.lit(1.0).alias("weight")))
    )


_EDGES = """forward AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'calls' AS relation, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'extends', 2.0 FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'declares', 1.0 FROM nation
), edges AS (
  SELECT * FROM forward UNION ALL
  SELECT dst, src, CASE relation WHEN 'calls' THEN 'called_by' WHEN 'extends' THEN 'extends_by' ELSE 'defined_in' END, weight FROM forward
)"""


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_inverse(_edges(spark, sf_dir))


def _seed(spark: SparkSession, node: str) -> DataFrame:
    return spark.range(1).select(F.lit(node).alias("node"))


@query(
    f"""
WITH RECURSIVE {_EDGES}, walk(node, depth) AS (
  SELECT 'n:3', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 2
), levels AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT l.node, l.depth, (SELECT min(relation) FROM edges JOIN levels p ON p.node = src WHERE dst = l.node AND p.depth = l.depth - 1) AS relation FROM levels l
"""
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs_levels(graph.with_inverse(_edges(spark, sf_dir)), _seed(spark, "n:3"), 2)


@query(
    f"""
WITH RECURSIVE {_EDGES}, one AS (SELECT 'o:' || min(o_orderkey) AS a FROM orders), walk(node, depth) AS (
  SELECT a, 0 FROM one UNION SELECT dst, depth + 1 FROM walk JOIN forward ON src = node WHERE depth < 4
), levels AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT p.depth + 1 AS hop, src, dst, relation FROM forward JOIN levels p ON p.node = src
"""
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first order to its region: the only path there is."""
    edges = _edges(spark, sf_dir)
    row = table(spark, sf_dir, "orders").orderBy("o_orderkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).orderBy("o_orderkey").select("o_orderkey", "n_regionkey").first()
    return graph.shortest_path(edges, f"o:{row['o_orderkey']}", f"r:{row['n_regionkey']}", 4)


def _unrolled(iterations: int) -> str:
    steps = ["r0 AS (SELECT node, p, dangling, p AS rank FROM base)"]
    for i in range(1, iterations + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT r.node, p, dangling, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE dangling)) * p + 0.85 * coalesce(g.gain, 0) AS rank FROM r{i - 1} r "
            f"LEFT JOIN (SELECT dst AS node, sum(rank * share) AS gain FROM e JOIN r{i - 1} ON node = src GROUP BY dst) g USING (node))"
        )
    return ", ".join(steps)


_RANKS = """
WITH forward AS (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 2.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 1.0 FROM nation UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey, 1.0 FROM nation
), e AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM forward),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
base AS (SELECT node, CASE WHEN node IN ('c:1', 'n:2') THEN 1.0 / (SELECT count(*) FROM nodes WHERE node IN ('c:1', 'n:2')) ELSE 0.0 END::DOUBLE AS p, node NOT IN (SELECT src FROM e) AS dangling FROM nodes),
"""


@query(f"{_RANKS}{_unrolled(10)} SELECT node, round(rank, 6) AS rank FROM r10")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after ten steps, as in the SQL; ``pagerank_converged`` goes on to the operator's end."""
    return graph.pagerank(*_rank_graph(spark, sf_dir), iterations=10, tolerance=0).select("node", F.round("rank", 6).alias("rank"))


@query(f"{_RANKS}{_unrolled(30)} SELECT node, round(rank, 6) AS rank FROM r30")
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's defaults: up to 30 steps, L1 tolerance 1e-6, which this graph doesn't reach before."""
    return graph.pagerank(*_rank_graph(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


def _rank_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    up = n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    edges = c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit(2.0).alias("weight")).unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return edges, _seed(spark, "c:1").union(_seed(spark, "n:2"))


@query(
    f"""
WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 'n:3', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 2),
levels AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
own AS (SELECT src, dst, sum(weight) AS w FROM edges WHERE src IN (SELECT node FROM levels WHERE depth < 2) GROUP BY src, dst),
e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM own),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
base AS (SELECT node, (node = 'n:3')::INT::DOUBLE AS p, node NOT IN (SELECT src FROM e) AS dangling FROM nodes),
{_unrolled(30)}, rows_ AS (
  SELECT l.node, l.depth, (SELECT min(relation) FROM edges JOIN levels p ON p.node = src WHERE dst = l.node AND p.depth = l.depth - 1) AS relation, coalesce(rank, 0) AS rank,
    CASE WHEN l.depth = 1 THEN 'direct' ELSE 'indirect' END AS affected FROM levels l LEFT JOIN r30 USING (node) WHERE l.depth > 0
), cut AS (SELECT *, row_number() OVER (PARTITION BY affected ORDER BY round(rank, 9) DESC, depth, node) AS k FROM rows_)
SELECT node, depth, relation, round(rank, 6) AS rank, affected FROM cut WHERE k <= CASE affected WHEN 'direct' THEN 50 ELSE 100 END
"""
)
def impact_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(graph.with_inverse(_edges(spark, sf_dir)), _seed(spark, "n:3"), 2).withColumn("rank", F.round("rank", 6))


@query("SELECT dir, count(*) AS n, CASE WHEN count(*) >= 8 THEN 'alto' WHEN count(*) >= 4 THEN 'medio' ELSE 'baixo' END AS risk FROM (SELECT regexp_extract(url, '^(.*)/', 1) AS dir FROM pages) GROUP BY dir")
def risk_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "pages").groupBy(tx.dirname(F.col("url")).alias("dir")).agg(F.count("*").alias("n"))
    return by.withColumn("risk", structure.risk(F.col("n")))


@query("SELECT DISTINCT regexp_extract(url, '^(.*)/', 1) AS area FROM pages")
def affected_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(tx.dirname(F.col("url")).alias("area")).distinct()


@query(
    """
SELECT page_id AS diff, 'p' || page_id AS path, (3 + page_id % 70)::INT AS start_line, (6 + page_id % 70)::INT AS end_line FROM pages
UNION ALL SELECT page_id, 'p' || page_id, (9 + page_id % 50)::INT, (11 + page_id % 50)::INT FROM pages
UNION ALL SELECT page_id, 'gone' || page_id, 1, 1 FROM pages
"""
)
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of a patch for every page: a change, a deletion whose removed line looks like a header, and a file that goes away."""
    p = table(spark, sf_dir, "pages")
    at = lambda n, m: (F.lit(n) + F.col("page_id") % m).cast("string")
    lines = [F.concat(F.lit("--- a/p"), "page_id"), F.concat(F.lit("+++ b/p"), "page_id"), F.concat(F.lit("@@ -1,2 +"), at(3, 70), F.lit(",4 @@ x")), F.lit("+line"), F.lit("--- a/text")]
    lines += [F.concat(F.lit("@@ -"), at(9, 50), F.lit(",3 +12,0 @@")), F.concat(F.lit("--- a/gone"), "page_id"), F.lit("+++ /dev/null"), F.lit("@@ -1 +0,0 @@")]
    return diffs.parse_hunks(p.select(F.col("page_id").alias("diff"), F.posexplode(F.array(*lines)).alias("line_no", "line")))


_LAST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


@query(_LAST)
def last_event_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return structure.last_event_wins(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM s GROUP BY user_id, sid
"""
)
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts that a quiet gap of 30 minutes ends."""
    from skarn.streaming import debounce

    return debounce.quiet_batches(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes").select("user_id", "first_ts", "n_events", "n_types")


@query(
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS OR event_id = 5 ORDER BY (event_id = 5) DESC, ts DESC, event_id DESC LIMIT 50"
)
def handle_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    h = e.select(F.col("event_id").alias("handle"), F.col("ts").alias("created_at"))
    return structure.evict(h, now, protected=F.col("handle") == 5).select(F.col("handle").alias("event_id"), F.col("created_at").alias("ts"))


@query(f"WITH d AS (SELECT href, count(*) AS n FROM ({_HREFS}) GROUP BY href HAVING count(*) >= 2) SELECT href, n, '$' || (row_number() OVER (ORDER BY href) - 1) AS alias FROM d WHERE (SELECT count(*) FROM d) >= 2")
def path_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.path_dictionary(_hrefs(spark, sf_dir).select("href"), "href")


@query(
    """
SELECT event_type AS kind, count(*) AS n, round(sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END), 4) AS base, round(sum(CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END), 4) AS tool,
  floor((sum(CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END) / sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) - 1) * 1000 + 0.5) / 10 AS gain_percent
FROM events GROUP BY event_type
"""
)
def benchmark_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = lambda k: F.sum(F.when(F.col("user_id") % 2 == k, F.col("value")).otherwise(0))
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), arm(0).alias("b"), arm(1).alias("t"))
    return by.select("kind", "n", F.round("b", 4).alias("base"), F.round("t", 4).alias("tool"), tx.half_up((F.col("t") / F.col("b") - 1) * 100, 1).alias("gain_percent"))


_COSTS = """
SELECT o_custkey AS goal, o_orderkey AS seq, (1 + o_totalprice / 1000)::BIGINT AS cost, (1 + o_orderkey % 40)::BIGINT AS brief, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders
"""


_SHORT = "CASE WHEN cost <= {0} THEN cost WHEN 3 * brief <= {0} THEN 3 * brief WHEN brief <= {0} THEN brief ELSE 0 END"
_ACTION = "CASE WHEN cost <= {0} THEN 'included' WHEN brief <= {0} THEN 'summarized' ELSE 'removed' END"


@query(
    f"""
WITH RECURSIVE s AS ({_COSTS.replace("(1 + o_totalprice / 1000)::BIGINT", "floor(1 + o_totalprice / 1000)::BIGINT")}), walk AS (
  SELECT goal, seq, k, {_ACTION.format("400")} AS action, {_SHORT.format("400")} AS spent, 400 - {_SHORT.format("400")} AS room FROM s WHERE k = 1
  UNION ALL
  SELECT s.goal, s.seq, s.k, {_ACTION.format("room")}, {_SHORT.format("room")}, room - {_SHORT.format("room")} FROM walk JOIN s ON s.goal = walk.goal AND s.k = walk.k + 1
) SELECT goal, seq, action, spent::BIGINT AS spent FROM walk
"""
)
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    segments = o.select(F.col("o_custkey").alias("goal"), F.col("o_orderkey").alias("seq"), F.floor(1 + F.col("o_totalprice") / 1000).alias("cost"), F.array(1 + F.col("o_orderkey") % 40, 3 + 3 * (F.col("o_orderkey") % 40)).alias("summary_costs"))
    return packing.budget_pack(segments, 400)


