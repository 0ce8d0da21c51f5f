"""Queries of the operators for training text, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import frequent, groups, leak, mixture, near, spans
from strandloom.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near.near_pairs(table(spark, sf_dir, "uniq_reads"), "read_id", "read")
    return pairs.select(F.col("a").alias("read_id_a"), F.col("b").alias("read_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read with a near one: its group, and how many near reads it has."""
    pairs = near.near_pairs(table(spark, sf_dir, "uniq_reads"), "read_id", "read").select("a", "b")
    pairs = cut_lineage(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return groups.link_groups(pairs).join(ends, "node").select(F.col("node").alias("read_id"), "group_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_items(table(spark, sf_dir, "uniq_reads"), "read", F.col("cnt"), 1 / 250).select("read")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a thousandth of the total, and their exact totals."""
    return frequent.frequent_items(table(spark, sf_dir, "uniq_reads"), "read", F.col("cnt"), 1 / 1000).select("read", "total")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, parents = table(spark, sf_dir, "pair_list").select("a", "b"), table(spark, sf_dir, "uf_nodes")
    return pairs.unionByName(parents.select(F.col("node").alias("a"), F.col("p").alias("b")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.link_groups(_links(spark, sf_dir))


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.link_groups(_links(spark, sf_dir)).groupBy("group_id").agg(F.count("*").alias("size"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked: documents that hold them and the longest match."""
    places = leak.leak_places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return places.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("n_words").alias("longest"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left in each source after those with leaks are removed."""
    clean = leak.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "eval_items"))
    return clean.groupBy("source").agg(F.count("*").alias("documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The plan, and the messages chosen by it."""
    counted = cut_lineage(mixture.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]))
    plan = cut_lineage(mixture.shares(counted.select("source", "tokens"), table(spark, sf_dir, "mix_targets")))
    return plan, mixture.select_blocks(counted, plan)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the quotas exhaust and whose tokens fall short of their share."""
    counted = mixture.token_counts(table(spark, sf_dir, "documents"), keep=["source"])
    return mixture.shares(counted, table(spark, sf_dir, "mix_targets")).where("short").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source was given and which share its chosen messages reach."""
    return mixture.reached(*_mixture(spark, sf_dir)).select("source", "target_share", "tokens", "quota", "used", "share", "short")


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the mixture as selected, by source: what the messages chosen add up to."""
    chosen = _mixture(spark, sf_dir)[1]
    return chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_times"), F.count("*").alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each message stands elsewhere: number of stretches, characters they cover, the longest one."""
    found = spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("stretches"), F.sum("length").alias("covered"), F.max("length").alias("longest"))


QUERIES = {
    "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_totals": p3_totals, "p4_found": p4_found, "p4_sizes": p4_sizes,
    "p6_found": p6_found, "p6_items": p6_items, "p6_clean": p6_clean, "p7_found": p7_found, "p7_shares": p7_shares, "p7_selection": p7_selection,
    "p8_found": p8_found, "p8_coverage": p8_coverage,
}

_TOTALS = "WITH t AS (SELECT read, sum(coalesce(cnt, 1)) AS total FROM uniq_reads GROUP BY read), n AS (SELECT sum(total) AS whole FROM t)"
_GROUPS = """WITH RECURSIVE l AS (SELECT a AS u, b AS v FROM pair_list UNION SELECT node, p FROM uf_nodes),
e AS (SELECT u, v FROM l WHERE u <> v UNION SELECT v, u FROM l WHERE u <> v),
r(node, seen) AS (SELECT u, u FROM e UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.node WHERE r.seen < e.v),
g AS (SELECT node, min(seen) AS group_id FROM r GROUP BY node)"""

#: The shorter text of a pair in nine even pieces, one of which stands in the other, no further off than the edits allow.
_NEAR = """WITH RECURSIVE t AS MATERIALIZED (SELECT min(read_id) AS id, read, length(read) AS n FROM uniq_reads WHERE read IS NOT NULL AND read_id IS NOT NULL GROUP BY read),
x AS (SELECT id, read, n AS l, unnest(range(9)) AS i FROM t),
xp AS (SELECT id, l, i, substr(read, CAST(i * l // 9 + 1 AS INT), CAST((i + 1) * l // 9 - i * l // 9 AS INT)) AS piece FROM x),
y AS (SELECT id, read, n, l, unnest(range(9)) AS i FROM (SELECT *, unnest(range(greatest(0, n - 8), n + 1)) AS l FROM t)),
yb AS (SELECT *, i * l // 9 AS b, (i + 1) * l // 9 - i * l // 9 AS size FROM y),
yp AS (SELECT id, n, l, i, substr(read, CAST(spot + 1 AS INT), CAST(size AS INT)) AS piece FROM (
  SELECT *, unnest(range(greatest(0, b - i, b + n - l - (8 - i)), least(n - size, b + i, b + n - l + (8 - i)) + 1)) AS spot FROM yb)),
met AS (SELECT DISTINCT least(xp.id, yp.id) AS a, greatest(xp.id, yp.id) AS b FROM xp JOIN yp USING (l, i, piece) WHERE xp.id <> yp.id AND (l < n OR xp.id < yp.id)),
near AS MATERIALIZED (SELECT a, b FROM met JOIN t ta ON ta.id = a JOIN t tb ON tb.id = b WHERE levenshtein(ta.read, tb.read) <= 8)"""
_WINDOWS = """WITH w AS MATERIALIZED (SELECT doc_id, k, md5(substr(text, CAST(k AS INT) + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 299)) AS k FROM documents)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))"""

SQL = {
    "p2_found": _NEAR + " SELECT a AS read_id_a, b AS read_id_b FROM near",
    "p2_groups": _NEAR + """, e AS MATERIALIZED (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
        r(node, seen) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.node WHERE r.seen < e.v),
        g AS (SELECT node, min(seen) AS group_id FROM r GROUP BY node), k AS (SELECT u, count(*) AS links FROM e GROUP BY u)
        SELECT node AS read_id, group_id, links FROM g JOIN k ON k.u = g.node""",
    "p8_found": _WINDOWS + " SELECT DISTINCT doc_id FROM w JOIN s USING (h)",
    "p8_coverage": _WINDOWS + """, m AS (SELECT DISTINCT doc_id, k FROM w JOIN s USING (h)),
        n AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 300 THEN 0 ELSE 1 END AS fresh FROM m),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM n),
        t AS (SELECT doc_id, max(k) - min(k) + 300 AS size FROM g GROUP BY doc_id, part)
        SELECT doc_id, count(*) AS stretches, CAST(sum(size) AS BIGINT) AS covered, CAST(max(size) AS INT) AS longest FROM t GROUP BY doc_id""",
    "p3_found": _TOTALS + " SELECT read FROM t, n WHERE read IS NOT NULL AND total * 250 >= whole",
    "p3_totals": _TOTALS + " SELECT read, CAST(total AS BIGINT) AS total FROM t, n WHERE read IS NOT NULL AND total * 1000 >= whole",
    "p4_found": _GROUPS + " SELECT node, group_id FROM g",
    "p4_sizes": _GROUPS + " SELECT group_id, count(*) AS size FROM g GROUP BY group_id",
}
