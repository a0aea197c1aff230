"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from .registry import query
from .relations import edges, files, over, snapshots, symbols


@query("g1_neighbours", over("edges", "SELECT id, count(*) FILTER (way = 'in') AS callers, count(*) FILTER (way = 'out') AS callees FROM (SELECT dst AS id, 'in' AS way FROM edges UNION ALL SELECT src, 'out' FROM edges) GROUP BY id"))
def g1(spark, d):
    """Direct predecessors and successors of every symbol, counted."""
    e = edges(spark, d)
    ends = e.select(F.col("dst").alias("id"), F.lit("in").alias("way")).unionByName(e.select(F.col("src").alias("id"), F.lit("out").alias("way")))
    return ends.groupBy("id").agg(F.count_if(F.col("way") == "in").alias("callers"), F.count_if(F.col("way") == "out").alias("callees"))


@query("g2_dependency_closure", over("edges", """, r AS (SELECT 1::BIGINT AS root, 1::BIGINT AS node, 0 AS depth UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 2)
SELECT root, node, min(depth) AS depth FROM r WHERE node <> root GROUP BY root, node""").replace("\n, r AS", ", r AS"))  # fmt: skip
def g2(spark, d):
    """What part 1 depends on within two steps."""
    return G.closure(edges(spark, d).select("src", "dst"), spark.createDataFrame([(1,)], "root long"), 2)


def _combined(leaf):
    """The order-free hash of a group in SQL."""
    part = lambda i: f"sum(('0x' || substr({leaf}, {1 + 15 * i}, 15))::BIGINT)"
    return "sha256(" + " || ':' || ".join(["count(*)", *map(part, range(4))]) + ")"


_TREE = f"t AS (SELECT split_part(path, '/', 1) AS folder, {_combined("sha256(path || ':' || hash)")} AS hash, count(*) AS n FROM files GROUP BY 1)"


@query("g3_hash_tree", over("files", f", {_TREE} SELECT * FROM t").replace("\n, t AS", ", t AS"))
def g3(spark, d):
    return G.folder_hashes(files(spark, d))


@query("g3_root_hash", over("files", f", {_TREE} SELECT {_combined("sha256(folder || ':' || hash)")} AS root FROM t").replace("\n, t AS", ", t AS"))
def g3_root(spark, d):
    """The hash of the whole tree."""
    return G.root_hash(G.folder_hashes(files(spark, d)))


@query("g3_compare", over("old_files new_files", """SELECT coalesce(o.path, n.path) // 100 || '/' || coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM old_files o FULL JOIN new_files n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash OR o.path IS NULL OR n.path IS NULL"""))  # fmt: skip
def g3_compare(spark, d):
    """Two trees compared from the folders down."""
    trees = (x.select(F.expr("concat_ws('/', path div 100, path)").alias("path"), "hash") for x in snapshots(spark, d))
    return G.changed_paths(*trees)


@query("g4_containment", over("symbols", "SELECT p.id AS parent, count(*) AS children FROM symbols c JOIN symbols p ON p.id = c.parent_id WHERE c.id <> p.id GROUP BY p.id"))
def g4(spark, d):
    """Children of every containing symbol."""
    s = symbols(spark, d)
    kids = s.where("id <> parent_id").groupBy(F.col("parent_id").alias("parent")).agg(F.count("*").alias("children"))
    return kids.join(s.select(F.col("id").alias("parent")), "parent")
