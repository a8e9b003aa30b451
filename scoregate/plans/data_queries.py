"""Queries over manifests, inventories, contracts, scalar functions and sinks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from scoregate.functions import scalars as S
from scoregate.operators import contracts as c, inventory as inv, partition, prefix
from scoregate.plans import inputs as I
from scoregate.plans.registry import query
from scoregate.sources import bundles, files, records
from scoregate.sources.stages import stage_path as _scratch, staged
from scoregate.streaming import guards, score_streams

PATHS_SQL = "paths AS (SELECT p_partkey, p_brand AS category, p_brand || '/' || replace(p_type, ' ', '_') || '/' || p_partkey || '.JPG' AS path, p_size FROM part)"


def paths(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.col("p_brand").alias("category"),
        F.concat_ws(
            "/",
            "p_brand",
            F.replace("p_type", F.lit(" "), F.lit("_")),
            F.concat(F.col("p_partkey").cast("string"), F.lit(".JPG"))
        ).alias("path"),
        "p_size"
    )


SELECT_SQL = f"""{PATHS_SQL}, dig AS (SELECT *, sha256('scoregate:42:' || path) AS selection_sha256,
    category || '-' || substring(sha256(path), 1, 16) AS record_id FROM paths),
sel AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY selection_sha256, path) AS selection_rank FROM dig)"""


@query(
    "seeded_partitions",
    f"WITH {SELECT_SQL} SELECT category, path, record_id, selection_sha256, selection_rank, CASE "
    f"WHEN selection_rank <= 20 THEN 'reference' ELSE 'calibration' END AS partition FROM sel"
)
def seeded_partitions(spark, sf_dir):
    return partition.seeded_partitions(
        paths(spark, sf_dir).select("category", "path"), I.NAMESPACE, I.SEED, 20, "category", "path"
    ).select("category", "path", "record_id", "selection_sha256", "selection_rank", "partition")


@query("first_by_digest", f"WITH {SELECT_SQL} SELECT path, selection_sha256 FROM sel ORDER BY selection_sha256, path LIMIT 25")
def first_by_digest(spark, sf_dir):
    return partition.first_by_digest(paths(spark, sf_dir).select("path"), I.NAMESPACE, I.SEED, "path", 25)


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in I.KEY.ljust(64, b"\0")).hex()


OPAQUE_SQL = f"""{PATHS_SQL}, mac AS (SELECT *, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(path)))) AS m FROM paths),
opaque AS (SELECT *, printf('asset-%06d', row_number() OVER (ORDER BY m, path) - 1) AS asset_id FROM mac)"""


@query("opaque_order", f"WITH {OPAQUE_SQL} SELECT path, asset_id, substring(asset_id, 7)::BIGINT AS asset_index FROM opaque")
def opaque_order(spark, sf_dir):
    return partition.opaque_order(paths(spark, sf_dir).select("path"), I.KEY, "path").select(
        "path", "asset_id", S.asset_index(F.col("asset_id")).alias("asset_index")
    )


@query("opaque_split", f"WITH {OPAQUE_SQL} SELECT asset_id, p_size, path AS source_path, category AS class_label FROM opaque")
def opaque_split(spark, sf_dir):
    """The two sides of the split, joined again on asset_id as at the reveal."""
    items, sealed = partition.split_labels(paths(spark, sf_dir), I.KEY, "path", "category", ["p_size"])
    return items.join(sealed, "asset_id")


@query("path_ordinals", f"WITH {PATHS_SQL} SELECT category, path, row_number() OVER (PARTITION BY category ORDER BY path) AS ordinal FROM paths")
def path_ordinals(spark, sf_dir):
    return prefix.ordinals(paths(spark, sf_dir).select("category", "path"), ["category"], ["path"])


@query("category_filter", f"""WITH {PATHS_SQL}, r AS (SELECT category, CASE
    WHEN p_partkey % 7 = 0 THEN 'Brand#21' || substring(path, strpos(path, '/')) ELSE path END AS path, p_size FROM paths)
SELECT path, p_size, starts_with(path, 'Brand#12/') AS is_inside FROM r WHERE category = 'Brand#12'""")
def category_filter(spark, sf_dir):
    """Rows of a category, some of whose paths lie in another one's folder."""
    p = paths(spark, sf_dir)
    moved = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("Brand#21/"), F.substring_index("path", "/", -2))).otherwise(F.col("path"))
    return p.where(S.in_category(F.col("category"), "Brand#12")).select(
        moved.alias("path"), "p_size", S.under_category(F.col("category"), moved).alias("is_inside")
    )


@query("safe_paths", """WITH t AS (SELECT page_id, url AS path FROM pages UNION ALL SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN source || '/a.JPG' WHEN 1 THEN '/' || source WHEN 2 THEN '../' || source WHEN 3 THEN source || '/../x'
    WHEN 4 THEN source || '\\x' ELSE NULL END FROM documents)
SELECT page_id AS item, coalesce(path, '') <> '' AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0
    AND NOT contains(path, '\\') AS is_safe,
  coalesce(path, '') <> '' AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0
    AND NOT contains(path, '\\') AND NOT contains(path, ':') AS is_safe_strict FROM t""")
def safe_paths(spark, sf_dir):
    k, s = F.col("doc_id") % 6, F.col("source")
    made = F.when(
        k == 0, F.concat(s, F.lit("/a.JPG"))
    ).when(k == 1, F.concat(F.lit("/"), s)).when(k == 2, F.concat(F.lit("../"), s)).when(
        k == 3, F.concat(s, F.lit("/../x"))
    ).when(k == 4, F.concat(s, F.lit("\\x")))
    t = I.table(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), F.col("url").alias("path")).unionByName(
        I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), made.alias("path"))
    )
    return t.select("item", S.safe_relative_path(F.col("path")).alias("is_safe"), S.safe_relative_path(F.col("path"), True).alias("is_safe_strict"))


@query("split_rule_violations", """WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test'
    ELSE 'other' END AS split, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'anomaly' WHEN '2' THEN NULL
    WHEN '3' THEN 'odd' ELSE 'normal' END AS label FROM orders)
SELECT o_orderkey, CASE split WHEN 'train' THEN 'train_not_normal' WHEN 'test' THEN 'test_label_unknown' ELSE 'unknown_split' END AS rule FROM r
WHERE split = 'other' OR (split = 'train' AND label IS DISTINCT FROM 'normal') OR (split = 'test' AND (label IS NULL OR label NOT IN ('normal', 'anomaly')))""")
def split_rule_violations(spark, sf_dir):
    """Orders as split rows: training rows must be normal, test rows normal or anomalies, and others are unknown."""
    status, first = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    split = F.when(status == "F", "train").when(status == "O", "test").otherwise("other")
    label = F.when(first == "1", "anomaly").when(first == "3", "odd").when(first != "2", "normal")
    rows = I.table(spark, sf_dir, "orders").select("o_orderkey", split.alias("split"), label.alias("label"))
    return c.split_violations(rows).select("o_orderkey", "rule")


@query("split_counts", "SELECT lang, source, count(*) AS row_count, count(DISTINCT n_chars) AS kinds FROM documents GROUP BY lang, source")
def split_counts(spark, sf_dir):
    return inv.split_counts(I.table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


@query(
    "label_free_projection",
    "SELECT doc_id AS item, sha256(coalesce(text, '')) AS content_sha256, octet_length(encode(coalesce(text, '')))::BIGINT AS byte_count FROM documents"
)
def label_free_projection(spark, sf_dir):
    """Items with byte identity and nothing that tells their label."""
    text = F.coalesce("text", F.lit(""))
    out = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item"),
        F.sha2(text, 256).alias("content_sha256"),
        F.octet_length(text).cast("long").alias("byte_count")
    )
    return c.require_columns(out, ["item", "content_sha256", "byte_count"], ("label", "quality", "toxic", "true_class"))


@query(
    "partition_overlap",
    "WITH t AS (SELECT doc_id AS item, 'documents' AS p FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels) "
    "SELECT item, count(*) AS row_count, count(DISTINCT p) AS partition_count FROM t GROUP BY item HAVING count(*) > 1"
)
def partition_overlap(spark, sf_dir):
    t = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.lit("documents").alias("p")).unionByName(
        I.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.lit("labels").alias("p"))
    )
    return partition.overlapping(t, "item", "p")


@query(
    "manifest_violations",
    f"WITH {SELECT_SQL} SELECT record_id, CASE WHEN selection_rank % 5 = 0 THEN 'unsafe_path' ELSE 'label_leak' END AS rule "
    f"FROM sel WHERE selection_rank % 5 = 0 OR selection_rank % 7 = 0"
)
def manifest_violations(spark, sf_dir):
    """A manifest in which every fifth path is unsafe and every seventh row of the final test carries its rank."""
    p = seeded_partitions(spark, sf_dir)
    final = F.col("selection_rank") % 7 == 0
    rows = p.select(
        "record_id",
        "category",
        F.when(F.col("selection_rank") % 5 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("relative_path"),
        F.when(final, "final-test").otherwise(F.col("partition")).alias("partition"),
        F.lit(None).cast("string").alias("label"),
        "selection_rank"
    )
    return c.manifest_violations(rows)


@query(
    "manifest_recomputation",
    f"WITH {SELECT_SQL} SELECT path, 'stored_only' AS side FROM sel WHERE selection_rank = 1 UNION ALL SELECT path, "
    f"'fresh_only' FROM sel WHERE selection_rank = 1"
)
def manifest_recomputation(spark, sf_dir):
    """A stored manifest whose first ranks were changed, against the recomputed selection."""
    from scoregate.operators.reproduce import recomputed_violations

    fresh = seeded_partitions(spark, sf_dir).select("path", "selection_rank")
    stored = fresh.withColumn("selection_rank", F.when(F.col("selection_rank") == 1, 1000).otherwise(F.col("selection_rank")))
    return recomputed_violations(stored, fresh, "manifest").select(F.get_json_object("row_json", "$.path").alias("path"), "side")


@query("inventory_reconciliation", """WITH e AS (SELECT o_orderkey AS k, o_custkey % 5 AS lines FROM orders), o AS (SELECT CASE
    WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS k, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT k AS order_key, CASE WHEN o.lines IS NULL THEN 'missing' WHEN e.lines IS NULL THEN 'extra'
    ELSE 'line_count' END AS diff_kind FROM e FULL JOIN o USING (k) WHERE e.lines IS DISTINCT FROM o.lines""")
def inventory_reconciliation(spark, sf_dir):
    """Orders against what their lines say, some of which stand under a key that no order has."""
    e = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), (F.col("o_custkey") % 5).alias("line_count"))
    key = F.when(F.col("l_orderkey") % 11 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("order_key")
    o = I.table(spark, sf_dir, "lineitem").groupBy(key).agg(F.count(F.lit(1)).alias("line_count"))
    return inv.reconcile(e, o, "order_key", ["line_count"])


@query(
    "evidence_identity",
    "SELECT d.doc_id AS item, CASE WHEN l.doc_id IS NULL THEN 'absent' WHEN l.quality = 1 THEN 'verified' "
    "ELSE 'changed' END AS verification FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def evidence_identity(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.lit(1).alias("quality"))
    return inv.evidence(
        d, I.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), "quality"), "item", ["quality"]
    ).select("item", "verification")


@query("lineage_digests", """WITH d AS (SELECT lang, md5(coalesce(text, '')) AS a, md5(coalesce(text, '') || CASE WHEN lang = 'es'
    AND doc_id % 10 = 0 THEN 'x' ELSE '' END) AS b FROM documents)
SELECT lang, count(*) AS input_count, bool_and(a = b) AS lineage_intact FROM d GROUP BY lang""")
def lineage_digests(spark, sf_dir):
    """Digests recorded of the documents against those of a written copy, in which some texts of one language were changed."""
    changed = (F.col("lang") == "es") & (F.col("doc_id") % 10 == 0)
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    copy = staged(docs.withColumn("text", F.when(changed, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    digests = lambda df: df.select(F.col("doc_id").alias("item"), "lang", F.md5("text").alias("digest"))
    return inv.lineage_by(digests(docs), digests(copy), "item", "digest", ["lang"])


@query("preflight_conditions", """WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'size' WHEN doc_id % 3 = 1 THEN 'lang'
    ELSE 'source' END AS gate, n_chars >= 0 AND (doc_id % 3 <> 1 OR lang <> 'es') AS ok FROM documents),
g AS (SELECT gate, CASE gate WHEN 'size' THEN 1 WHEN 'lang' THEN 2 ELSE 3 END AS gate_order, bool_and(ok) AS passed FROM f
    GROUP BY gate), h AS (SELECT *, min(CASE WHEN NOT passed THEN gate_order END) OVER () AS first_failed_order FROM g)
SELECT gate, gate_order, passed, CASE WHEN first_failed_order IS NULL OR gate_order < first_failed_order THEN 'pass'
    WHEN gate_order = first_failed_order THEN 'fail' ELSE 'not_evaluated' END AS gate_status FROM h""")
def preflight_conditions(spark, sf_dir):
    """Conditions over the facts of all rows, then ordered up to the first failure."""
    from scoregate.operators.evaluation import short_circuit

    k = F.col("doc_id") % 3
    f = I.table(spark, sf_dir, "documents").select(
        F.when(k == 0, "size").when(k == 1, "lang").otherwise("source").alias("gate"),
        ((F.col("n_chars") >= 0) & ((k != 1) | (F.col("lang") != "es"))).alias("ok")
    )
    order = F.when(F.col("gate") == "size", 1).when(F.col("gate") == "lang", 2).otherwise(3)
    g = f.groupBy("gate").agg(F.bool_and("ok").alias("passed")).withColumn("gate_order", order).withColumn("method", F.lit("all"))
    return short_circuit(g).select("gate", "gate_order", "passed", "gate_status")


@query(
    "state_presence",
    "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 AND o.k IS NOT NULL THEN 'state_of_failed_fit' "
    "ELSE 'state_missing' END AS rule FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey "
    "WHERE (c_custkey % 7 = 0 AND o.k IS NOT NULL) OR (c_custkey % 7 <> 0 AND o.k IS NULL)"
)
def state_presence(spark, sf_dir):
    """Customers as fits (every seventh failed), their orders as stored states."""
    fits = I.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 7 == 0, "failed").otherwise("ok").alias("fit_status"),
        F.lit("d").alias("digest")
    )
    states = I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("d").alias("digest")).distinct()
    return inv.state_presence(fits, states, "k", "digest")


@query(
    "ordered_digest",
    f"WITH {PATHS_SQL} SELECT category, sha256(string_agg(path || chr(9) || sha256(path) || chr(10), '' ORDER BY path)) AS digest FROM paths GROUP BY category"
)
def ordered_digest(spark, sf_dir):
    return inv.flat_digest(paths(spark, sf_dir), ["category"], "path", F.concat("path", F.lit("\t"), F.sha2("path", 256)))


@query("two_level_digest", f"""WITH {PATHS_SQL}, p AS (SELECT substring(sha256(path), 1, 2) AS cut, path
    FROM paths), q AS (SELECT cut, sha256(string_agg(path || chr(0) || sha256(path), chr(10) ORDER BY path)) AS part, count(*) AS n FROM p GROUP BY cut)
SELECT sha256(string_agg(cut || ':' || part, chr(10) ORDER BY cut)) AS digest, sum(n)::BIGINT AS line_count FROM q""")
def two_level_digest(spark, sf_dir):
    return inv.ordered_digest(paths(spark, sf_dir), [], "path", F.concat("path", F.lit("\0"), F.sha2("path", 256)))


@query("inventory_totals", "SELECT source AS prefix, count(*) AS item_count, sum(n_chars)::BIGINT AS byte_total FROM documents GROUP BY ROLLUP (source)")
def inventory_totals(spark, sf_dir):
    return inv.totals(I.table(spark, sf_dir, "documents"), F.col("source"), "n_chars")


@query(
    "array_inventory",
    "SELECT label, count(*) AS array_count, sum(len(embedding))::BIGINT AS element_count, "
    "bool_and(vec_id % 40 <> 3) AS all_finite, sum(len(embedding))::BIGINT * 4 AS byte_count FROM embeddings GROUP BY label"
)
def array_inventory(spark, sf_dir):
    """Embeddings by label, some with a component that isn't a number."""
    e = F.col("embedding")
    broken = F.when(
        F.col("vec_id") % 40 == 3,
        F.concat(F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), F.array(F.lit(float("nan")).cast("float")))
    ).otherwise(e)
    return inv.array_inventory(I.table(spark, sf_dir, "embeddings").withColumn("embedding", broken), "label", "embedding")


KIND_SQL = "k AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || '/LICENSE.txt' WHEN 1 THEN p_brand || '/lib' || p_partkey || '.so.1' WHEN 2 THEN 'NOTICE' WHEN 3 THEN p_brand || '/AUTHORS' ELSE p_brand || '/a.py' END AS path FROM part)"


@query(
    "path_kinds",
    f"WITH {KIND_SQL} SELECT CASE p_partkey % 5 WHEN 0 THEN 'license' WHEN 1 THEN 'native' WHEN 2 THEN 'notice' "
    f"WHEN 3 THEN 'attribution' ELSE 'other' END AS kind, count(*) AS member_count FROM k GROUP BY 1"
)
def path_kinds(spark, sf_dir):
    k, b = F.col("p_partkey") % 5, F.col("p_brand")
    path = F.when(k == 0, F.concat(b, F.lit("/LICENSE.txt"))).when(
        k == 1, F.concat(b, F.lit("/lib"), F.col("p_partkey").cast("string"), F.lit(".so.1"))
    ).when(k == 2, "NOTICE").when(k == 3, F.concat(b, F.lit("/AUTHORS"))).otherwise(F.concat(b, F.lit("/a.py")))
    return I.table(spark, sf_dir, "part").select(
        F.coalesce(inv.path_kind(path), F.lit("other")).alias("kind")
    ).groupBy("kind").agg(F.count(F.lit(1)).alias("member_count"))


EDGES_SQL = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _edges(spark, sf_dir):
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    parts = [
        I.table(spark, sf_dir, t).select(name(a, x).alias("src"), name(b, y).alias("dst"))
        for t, a, x, b, y in (
            ("customer", "c", "c_custkey", "n", "c_nationkey"),
            ("nation", "n", "n_nationkey", "r", "n_regionkey"),
            ("supplier", "s", "s_suppkey", "n", "s_nationkey")
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("reachability_closure", f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT DISTINCT src AS node, 0 AS depth FROM edges
    WHERE src LIKE 'c%' UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = node)
SELECT node, min(depth)::INT AS depth FROM reach GROUP BY node""")
def reachability_closure(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return inv.closure(e.where("src like 'c%'").select(F.col("src").alias("node")), e)


@query("dependency_roles", f"""WITH RECURSIVE {EDGES_SQL}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst
    FROM edges), a AS (SELECT src AS node FROM edges WHERE src LIKE 'c%' UNION SELECT dst FROM a
    JOIN edges ON src = node), b AS (SELECT src AS node FROM edges WHERE src IN (SELECT 's' || s_suppkey FROM supplier
    WHERE s_acctbal > 5000) UNION SELECT dst FROM b JOIN edges ON src = node)
SELECT node, CASE WHEN node IN (SELECT node FROM a) THEN 'runtime' WHEN node IN (SELECT node FROM b) THEN 'development' ELSE 'orphan' END AS role FROM nodes""")
def dependency_roles(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    rich = I.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return inv.roles(nodes, inv.closure(e.where("src like 'c%'").select(F.col("src").alias("node")), e), inv.closure(rich, e, nodes))


@query("missing_nodes", f"""WITH {EDGES_SQL}, nodes AS (SELECT src AS node FROM edges WHERE src NOT LIKE 'n1%' UNION SELECT dst
    FROM edges WHERE dst NOT LIKE 'r%' AND dst NOT LIKE 'n1%'),
a AS (SELECT src AS node, 'root' AS role FROM edges WHERE src LIKE 'c%' UNION SELECT src, 'src' FROM edges UNION SELECT dst, 'dst'
    FROM edges) SELECT * FROM a WHERE node NOT IN (SELECT node FROM nodes)""")
def missing_nodes(spark, sf_dir):
    """An inventory without regions and some nations: what the dependencies name and it doesn't have."""
    e = _edges(spark, sf_dir)
    named = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().where(
        "node not like 'n1%' and node not like 'r%'"
    )
    return inv.missing_nodes(e.where("src like 'c%'").select(F.col("src").alias("node")), e, named)


@query("row_contract_violations", """SELECT 'l_discount:above_maximum' AS rule, l_orderkey || '-' || l_linenumber AS row_key
    FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'l_returnflag:not_allowed', l_orderkey || '-' || l_linenumber
    FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'l_quantity:below_minimum', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_quantity < 2""")
def row_contract_violations(spark, sf_dir):
    l = I.table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))  # noqa: E741
    fields = [c.Field("l_discount", low=0.0, high=0.09), c.Field("l_returnflag", values=("A", "N")), c.Field("l_quantity", low=2.0), c.Field("l_shipdate")]
    return c.row_violations(l, fields, "key").select("rule", "row_key")


@query("duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return c.key_violations(I.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "rank_contiguity",
    "SELECT l_orderkey, count(*) AS row_count, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT "
    "l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey"
)
def rank_contiguity(spark, sf_dir):
    return c.contiguity(I.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@query(
    "single_run",
    "SELECT count(DISTINCT lang) AS lang_values, count(DISTINCT source) AS source_values, "
    "count(DISTINCT lang) = 1 AND count(DISTINCT source) = 1 AS single_run FROM documents"
)
def single_run(spark, sf_dir):
    return c.single_valued(I.table(spark, sf_dir, "documents"), ["lang", "source"])


@query(
    "scalar_functions",
    """SELECT p_partkey, regexp_replace(lower(p_name), '[-_. ]+', '-', 'g') AS canonical, p_name LIKE '% %' AS has_space,
    md5(p_name) AS digest, round(degrees(atan2(p_retailprice, p_size)), 9) AS angle,
    ceil(p_retailprice * 0.07::DOUBLE)::BIGINT AS ceiling, length(trim(p_name)) BETWEEN 1 AND 12 AS is_short FROM part"""
)
def scalar_functions(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select(
        "p_partkey",
        S.canonical_name(F.regexp_replace("p_name", " ", "-")).alias("canonical"),
        F.col("p_name").contains(" ").alias("has_space"),
        F.md5("p_name").alias("digest"),
        F.round(F.degrees(F.atan2("p_retailprice", "p_size")), 9).alias("angle"),
        F.ceil(F.col("p_retailprice") * F.lit(0.07)).alias("ceiling"),
        S.short_text(F.col("p_name"), 12).alias("is_short")
    )


@query("canonical_dates", "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_canonical FROM orders")
def canonical_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).otherwise(
        F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("x"))
    )
    return I.table(spark, sf_dir, "orders").select("o_orderkey", S.canonical_date(text).alias("is_canonical"))


@query(
    "json_properties",
    """SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN json_extract_string(props, '$.k') END AS k, props IS NOT NULL
    AND event_id % 5 NOT IN (0, 1) AS is_object, props IS NOT NULL AND event_id % 5 NOT IN (0, 1) AS same_value FROM events"""
)
def json_properties(spark, sf_dir):
    """Properties as they are, with another spacing and key order, as arrays, and cut off."""
    k, p = F.col("event_id") % 5, F.col("props")
    spaced = F.concat(F.lit('{ "z" : [1, 2], '), F.substr(p, F.lit(2)))
    turned = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "z":[1,2]}'))
    held = F.when(k == 0, F.concat(F.lit("["), p, F.lit("]"))).when(k == 1, F.expr("substring(props, 1, length(props) - 1)")).when(k == 2, spaced).otherwise(p)
    other = F.when(k == 2, turned).when(k < 2, F.lit("{}")).otherwise(p)
    rows = I.table(spark, sf_dir, "events").select("event_id", held.alias("held"), other.alias("other"))
    key = F.coalesce(F.get_json_object("held", "$.k"), F.get_json_object("held", "$[0].k"))
    return rows.select(
        "event_id",
        key.alias("k"),
        S.is_object(F.col("held")).alias("is_object"),
        S.same_json(F.col("held"), F.col("other")).alias("same_value")
    )


@query(
    "casefold_clashes",
    "SELECT lower(p_brand) AS folded, count(DISTINCT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END) AS name_count "
    "FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS p_brand FROM part) "
    "GROUP BY lower(p_brand) HAVING count(DISTINCT p_brand) > 1"
)
def casefold_clashes(spark, sf_dir):
    """Brands that some rows write in capitals: names that differ in case alone."""
    brand = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return inv.case_clashes(I.table(spark, sf_dir, "part").select(brand.alias("name")), "name")


@query(
    "elementwise_arrays",
    "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x - 0.1))), 7) AS absolute_total, "
    "abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) < 1e-5 AS is_unit FROM embeddings"
)
def elementwise_arrays(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    away = F.aggregate(F.transform(e, lambda x: F.abs(x - 0.1)), F.lit(0.0), lambda s, x: s + x)
    return I.table(spark, sf_dir, "embeddings").select("vec_id", F.round(away, 7).alias("absolute_total"), (F.abs(S.dot(e, e) - 1) < 1e-5).alias("is_unit"))


@query("csv_round_trip", f"WITH {I.CLASSIFIED_SQL} SELECT method, item, score_status, failure_code, score, is_anomalous FROM classified")
def csv_round_trip(spark, sf_dir):
    """Classified rows written as contract CSV and read back with their types and nulls."""
    df = I.classified(spark, sf_dir).select("method", "item", "score_status", "failure_code", "score", "is_anomalous")
    path = f"{_scratch(spark)}/classified"
    files.write_csv(df, path, ["method", "item"])
    return files.read_csv(spark, path, df.schema)


@query("jsonl_round_trip", f"WITH {SELECT_SQL} SELECT category, path, record_id, selection_rank FROM sel")
def jsonl_round_trip(spark, sf_dir):
    df = seeded_partitions(spark, sf_dir).select("category", "path", "record_id", "selection_rank")
    path = f"{_scratch(spark)}/manifest"
    files.write_jsonl(df, path)
    return files.read_jsonl(spark, path, df.schema)


@query("bundle_manifest", f"""WITH {I.CLASSIFIED_SQL}, m AS (SELECT 'classification' AS artifact_type, method,
    count(*) AS record_count FROM classified GROUP BY method UNION ALL SELECT 'calibration_score', method, count(*) FROM calibration GROUP BY method)
SELECT *, artifact_type || '/method=' || method AS relative_path, artifact_type = 'classification' AS intact, true AS digest_wellformed FROM m""")
def bundle_manifest(spark, sf_dir):
    """Tables written by method as one bundle, its manifest, and which entries hold when some stored rows are changed afterwards."""
    path = f"{_scratch(spark)}/bundle"
    tables = {"classification": I.classified(spark, sf_dir), "calibration_score": I.calibration(spark, sf_dir)}
    bundles.write_bundle(tables, path)
    held = staged(spark.read.schema(tables["calibration_score"].schema).parquet(f"{path}/calibration_score"))
    held.withColumn("score", F.col("score") + 1).write.mode("overwrite").partitionBy("method").parquet(f"{path}/calibration_score")
    broken = bundles.bundle_violations(spark, path, {n: t.schema for n, t in tables.items()}).select("relative_path", F.lit(True).alias("broken"))
    out = bundles.read_manifest(spark, path).join(broken, "relative_path", "left")
    return out.select(
        "artifact_type",
        "method",
        "relative_path",
        "record_count",
        F.col("broken").isNull().alias("intact"),
        F.col("sha256").rlike(S.SHA256).alias("digest_wellformed")
    )


@query("state_round_trip", f"WITH {I.CALIBRATION_SQL} SELECT method, threshold, threshold_rank FROM cuts")
def state_round_trip(spark, sf_dir):
    """Fitted thresholds saved with their digest and loaded again after checking it."""
    from scoregate.operators.scores import thresholds

    path = f"{_scratch(spark)}/state"
    digest = bundles.save_state(thresholds(I.calibration(spark, sf_dir)).select("method", "threshold", "threshold_rank"), path)
    return bundles.load_state(spark, path, digest)


@query("array_store", "SELECT vec_id AS item, vec_id % 10 <> 4 AS verified, len(embedding)::INT AS element_count FROM embeddings")
def array_store(spark, sf_dir):
    """Arrays stored with a digest of each row, some of which were changed in the store before it is read and verified."""
    first, second = f"{_scratch(spark)}/arrays", f"{_scratch(spark)}/arrays"
    bundles.write_arrays(I.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", first)
    stored = spark.read.parquet(first)
    moved = F.transform("values", lambda x: x + 1).cast(stored.schema["values"].dataType)
    stored.withColumn("values", F.when(F.col("item") % 10 == 4, moved).otherwise(F.col("values"))).write.parquet(second)
    return bundles.read_arrays(spark, second).select("item", "verified", F.size("values").alias("element_count"))


@query(
    "byte_identities",
    "SELECT source, (count(*) * 33)::BIGINT AS byte_total, CASE WHEN source = 'src1' THEN 'changed' "
    "WHEN source = 'src2' THEN 'absent' ELSE 'verified' END AS verification FROM documents GROUP BY source"
)
def byte_identities(spark, sf_dir):
    """A line for each document in files by source, read as bytes and compared with a manifest by size and SHA-256 that is of other
    bytes for one source, and names another's files otherwise."""
    path = f"{_scratch(spark)}/assets"
    docs = I.table(spark, sf_dir, "documents").select("source", F.md5(F.concat(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string"))).alias("line"))
    files.write_bytes(docs, "line", path, "source")
    held = files.read_bytes(spark, path)
    source = F.regexp_extract("asset", "part=([^/]*)/", 1)
    manifest = files.byte_manifest(held, "asset", "content")
    manifest = manifest.withColumns(
        {
            "sha256": F.when(source == "src1", F.sha2("sha256", 256)).otherwise(F.col("sha256")),
            "asset": F.when(source == "src2", F.concat("asset", F.lit(".gone"))).otherwise(F.col("asset"))
        }
    )
    checked = files.verify_bytes(held, manifest, "asset", "content")
    return checked.groupBy(source.alias("source")).agg(F.sum("byte_count").alias("byte_total"), F.max("verification").alias("verification"))


@query(
    "stream_classification",
    "SELECT event_type AS method, count(*) AS event_count, count(*) FILTER (WHERE value > 50) AS anomalous_count FROM events GROUP BY event_type"
)
def stream_classification(spark, sf_dir):
    """Events as a stream of scores, each classified by its method's frozen threshold as it arrives."""
    cuts = I.table(spark, sf_dir, "events").select(F.col("event_type").alias("method")).distinct().withColumn("threshold", F.lit(50.0))
    out = score_streams.classified_events(spark, f"{sf_dir}/events.parquet", cuts, f"{_scratch(spark)}/stream")
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("event_count"), F.count_if("is_anomalous").alias("anomalous_count"))


@query("stream_unique_keys", "SELECT count(DISTINCT event_id) AS event_count FROM events")
def stream_unique_keys(spark, sf_dir):
    return score_streams.unique_events(spark, f"{sf_dir}/events.parquet", f"{_scratch(spark)}/stream").agg(F.count(F.lit(1)).alias("event_count"))


@query(
    "stream_window_counts",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS method, count(*) AS event_count, "
    "count(*) FILTER (WHERE value > 50) AS anomalous_count FROM events GROUP BY ALL"
)
def stream_window_counts(spark, sf_dir):
    return score_streams.window_counts(spark, f"{sf_dir}/events.parquet", 50.0, "1 day", f"{_scratch(spark)}/stream")


@query("stream_window_metrics", """WITH e AS (SELECT ts, event_type AS method, value, event_id % 9 = 0 AS failed,
    time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events),
w AS (SELECT window_start, method, count(*) AS event_count, count(*) FILTER (WHERE failed) AS failed_count,
    count(*) FILTER (WHERE failed OR value > 50) AS anomalous_count FROM e GROUP BY ALL)
SELECT *, anomalous_count / event_count AS anomalous_share, true AS p95_within FROM w
    WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_window_metrics(spark, sf_dir):
    """Counts, failures, anomalous share and p95 of daily windows, each given when the watermark has passed it, with whether the p95's
    rank among the window's rows is as near to 0.95 as is stated."""
    source, path = f"{sf_dir}/events.parquet", _scratch(spark)
    failing = lambda scores: scores.withColumn("score_status", F.when(F.col("item") % 9 == 0, "failed").otherwise("ok"))
    guards.drained(guards.window_metrics(failing(score_streams.scores_from(spark, source)), 50.0, "1 day", "10 minutes"), path)
    out = spark.read.parquet(f"{path}/out")
    batch = failing(
        I.table(spark, sf_dir, "events").select(
            F.col("event_id").alias("item"), F.col("event_type").alias("method"), "ts", F.col("value").alias("score")
        )
    )
    ranked = guards.p95_ranks(out, batch, "1 day")
    return ranked.select(
        "window_start",
        "method",
        "event_count",
        "failed_count",
        "anomalous_count",
        "anomalous_share",
        (F.col("p95_error") <= guards.RANK_ERROR).alias("p95_within")
    )


@query("stream_repeats", """SELECT event_type AS method, count(*) + count(*) FILTER (WHERE event_id % 15 = 0) AS first_count,
    count(*) FILTER (WHERE event_id % 10 = 0) AS repeat_count,
count(*) FILTER (WHERE event_id % 10 = 0) AS within_count FROM events GROUP BY event_type""")
def stream_repeats(spark, sf_dir):
    """Events with planted repeats, some five minutes later and some in a second run a day after the last event: how many rows begin a
    key and how many repeat one, and how many of these lie within the horizon of the row that they repeat."""
    base = _scratch(spark)
    events = I.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"), F.col("event_id").alias("item"), F.col("ts").cast("timestamp").alias("ts")
    )
    later = lambda df, at: df.withColumn("ts", at)
    own = guards.stateful_session(spark)
    near = later(events.where("item % 10 = 0"), F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    last = events.agg(F.max("ts").alias("last"))
    far = later(events.where("item % 15 = 0").join(F.broadcast(last)), F.col("last") + F.expr("INTERVAL 1 DAY")).drop("last")
    for rows in (events.unionByName(near), far):
        rows.write.mode("append").parquet(f"{base}/in")
        arriving = own.readStream.schema(events.schema).parquet(f"{base}/in")
        guards.drained(guards.guarded(arriving, ["item"], timedelta(minutes=10)), f"{base}/guard")
    out = spark.read.parquet(f"{base}/guard/out")
    gap = F.unix_micros("ts") - F.unix_micros("first_time")
    return out.groupBy("method").agg(
        F.count_if(~F.col("is_repeat")).alias("first_count"),
        F.count_if("is_repeat").alias("repeat_count"),
        F.count_if(F.col("is_repeat") & (gap <= 600_000_000)).alias("within_count")
    )


@query("tree_digests", f"""WITH {PATHS_SQL}, t AS (SELECT category, path, sha256(path) AS d, p_size FROM paths)
SELECT category, sha256(string_agg(path || chr(9) || p_size || chr(9) || d || chr(10), ''
    ORDER BY path)) AS sized, sha256(string_agg(path || '|' || d || chr(10), '' ORDER BY path)) AS plain FROM t GROUP BY category""")
def tree_digests(spark, sf_dir):
    """Digests of each category's paths in their order, with and without sizes."""
    p, digest = paths(spark, sf_dir), F.sha2("path", 256)
    sized = inv.flat_digest(p, ["category"], "path", inv.tree_line(F.col("path"), digest, F.col("p_size"))).withColumnRenamed("digest", "sized")
    plain = inv.flat_digest(p, ["category"], "path", inv.tree_line(F.col("path"), digest, separator="|")).withColumnRenamed("digest", "plain")
    return sized.join(plain, "category")


@query("whole_table_comparison", """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 997 = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
    FROM lineitem WHERE l_orderkey % 1009 <> 5 UNION ALL SELECT * FROM a WHERE l_orderkey % 991 = 7),
d AS (SELECT 'stored_only' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'fresh_only', *
    FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT side, l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, count(*) AS copies, true AS few_ranges FROM d GROUP BY ALL""")
def whole_table_comparison(spark, sf_dir):
    """A table against a copy with rows changed, dropped and repeated: the rows that differ with their copies, and whether no more ranges
    of hashes were compared row by row than rows differ."""
    from scoregate.operators.reproduce import only_differing

    a = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    k = F.col("l_orderkey")
    b = a.where(k % 1009 != 5).withColumn(
        "l_quantity", F.when(k % 997 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    ).unionByName(a.where(k % 991 == 7))
    stored, fresh, moved = only_differing(a, b)
    gone, new = (x.exceptAll(y).withColumn("side", F.lit(s)) for x, y, s in ((stored, fresh, "stored_only"), (fresh, stored, "fresh_only")))
    out = staged(gone.unionByName(new).groupBy("side", *a.columns).agg(F.count(F.lit(1)).alias("copies")))
    few = out.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).join(
        moved.agg(F.count(F.lit(1)).alias("m")), F.lit(True)
    ).select((F.col("m") <= F.col("n")).alias("few_ranges"))
    return out.join(few, F.lit(True))


@query(
    "published_bundle",
    f"""WITH {SELECT_SQL}, t AS (SELECT category AS method, selection_rank FROM sel WHERE selection_rank > 5)
    SELECT method, count(*) AS record_count, 2 AS version FROM t GROUP BY method"""
)
def published_bundle(spark, sf_dir):
    """Two versions of a bundle and an attempt that was never committed: what a reader sees."""
    rows = staged(seeded_partitions(spark, sf_dir).select(F.col("category").alias("method"), "selection_rank"))
    path = f"{_scratch(spark)}/bundle"
    bundles.publish({"ranks": rows}, path)
    bundles.publish({"ranks": rows.where("selection_rank > 5")}, path, replaces=1)
    bundles.write_bundle({"ranks": rows.limit(1)}, f"{path}/attempts/abandoned", staging=False)
    version, folder = bundles.open_bundle(spark, path)
    return bundles.read_manifest(spark, folder).select("method", "record_count", F.lit(version).alias("version"))


@query("sealed_mapping_report", f"""WITH {OPAQUE_SQL}, s AS (SELECT asset_id, path, category, substring(asset_id, 7)::BIGINT AS k FROM opaque),
n AS (SELECT max(k) AS top FROM s)
SELECT 'asset_malformed' AS rule, 'x' || asset_id AS key FROM s WHERE k % 100 = 10 UNION ALL SELECT 'unsafe_path', asset_id FROM s
    WHERE k % 100 = 20 UNION ALL SELECT 'class_missing', asset_id FROM s WHERE k % 100 = 30
UNION ALL SELECT 'asset_repeated', asset_id FROM s WHERE k % 100 = 40 UNION ALL SELECT 'path_repeated', path FROM s
    WHERE k % 100 = 40 UNION ALL SELECT 'asset_gap', top::VARCHAR FROM n""")
def sealed_mapping_report(spark, sf_dir):
    """A sealed mapping with ids changed and repeated, paths that leave their root and empty classes."""
    _, sealed = partition.split_labels(paths(spark, sf_dir), I.KEY, "path", "category", ["p_size"])
    k = S.asset_index(F.col("asset_id")) % 100
    sealed = staged(sealed.withColumn("k", k))
    rows = sealed.select(
        F.when(F.col("k") == 10, F.concat(F.lit("x"), "asset_id")).otherwise(F.col("asset_id")).alias("asset_id"),
        F.when(F.col("k") == 20, F.concat(F.lit("../"), "source_path")).otherwise(F.col("source_path")).alias("source_path"),
        F.when(F.col("k") != 30, F.col("class_label")).otherwise(F.lit(" ")).alias("class_label"), "k",
    )
    return c.sealed_violations(rows.unionByName(rows.where("k = 40")).drop("k"))


@query(
    "partition_labels",
    f"WITH {SELECT_SQL} SELECT record_id, CASE WHEN selection_rank <= 20 THEN 'reference' "
    f"WHEN selection_rank % 2 = 0 THEN 'calibration' ELSE 'final-test' END AS partition, CASE "
    f"WHEN selection_rank <= 20 OR selection_rank % 2 = 0 THEN category END AS label FROM sel"
)
def partition_labels(spark, sf_dir):
    """A manifest whose labels are shown for normal partitions and hidden for the final test."""
    rank = F.col("selection_rank")
    part = F.when(rank <= 20, "reference").when(rank % 2 == 0, "calibration").otherwise("final-test")
    rows = seeded_partitions(spark, sf_dir).select("record_id", part.alias("partition"), F.col("category").alias("label"))
    return c.with_partition_labels(rows)


@query("indexed_fetch", "SELECT vec_id AS item, true AS verified, len(embedding) AS element_count FROM embeddings WHERE vec_id IN (3, 77, 200)")
def indexed_fetch(spark, sf_dir):
    """Three arrays fetched by their index from a sorted store."""
    path = f"{_scratch(spark)}/arrays"
    bundles.write_indexed(I.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    return bundles.fetch(spark, path, [3, 77, 200]).select("item", "verified", F.size("values").cast("long").alias("element_count"))


@query("anchor_items", f"WITH {PATHS_SQL} SELECT category, min(path) AS anchor FROM paths GROUP BY category")
def anchor_items(spark, sf_dir):
    return partition.anchors(paths(spark, sf_dir), "category", "path", "anchor")


@query(
    "sealed_mapping_violations",
    f"WITH {OPAQUE_SQL} SELECT 'asset_id:malformed' AS rule, 'x' || asset_id AS row_key FROM opaque WHERE p_partkey % 10 = 0 "
    f"UNION ALL SELECT 'class_label:null', CASE WHEN p_partkey % 10 = 0 THEN 'x' || asset_id ELSE asset_id END FROM opaque WHERE p_partkey % 15 = 0"
)
def sealed_mapping_violations(spark, sf_dir):
    """A sealed mapping with malformed ids and missing labels."""
    sealed = partition.opaque_order(paths(spark, sf_dir), I.KEY, "path")
    k = F.col("p_partkey")
    rows = sealed.select(
        F.when(k % 10 == 0, F.concat(F.lit("x"), "asset_id")).otherwise(F.col("asset_id")).alias("asset_id"),
        F.col("path").alias("source_path"),
        F.when(k % 15 != 0, F.col("category")).alias("class_label")
    )
    return c.row_violations(
        rows, [c.Field("asset_id", pattern=S.ASSET_ID), c.Field("source_path"), c.Field("class_label")], "asset_id"
    ).select("rule", "row_key")


SPLIT_SQL = f"{PATHS_SQL}, s AS (SELECT category AS object, CASE WHEN p_size > 25 THEN 'train' ELSE 'test' END AS split, CASE WHEN p_size < 10 THEN 'anomaly' ELSE 'normal' END AS label, path AS image, CASE WHEN p_size < 10 THEN path END AS mask FROM paths)"


def _split_rows(spark, sf_dir):
    size = F.col("p_size")
    return paths(spark, sf_dir).select(
        F.col("category").alias("object"),
        F.when(size > 25, "train").otherwise("test").alias("split"),
        F.when(size < 10, "anomaly").otherwise("normal").alias("label"),
        F.col("path").alias("image"),
        F.when(size < 10, F.col("path")).alias("mask")
    )


@query(
    "split_table_scan",
    f"WITH {SPLIT_SQL} SELECT split, label, count(*) AS row_count, count(mask) AS mask_count FROM s WHERE object = 'Brand#11' OR object = 'Brand#1' GROUP BY ALL"
)
def split_table_scan(spark, sf_dir):
    """A split table written as contract CSV, scanned by category, for two of which one's name begins the other's."""
    path = f"{_scratch(spark)}/split"
    files.write_csv(_split_rows(spark, sf_dir), path, ["image"])
    out = files.read_split(spark, path, "Brand#11").unionByName(files.read_split(spark, path, "Brand#1"))
    return out.groupBy("split", "label").agg(F.count(F.lit(1)).alias("row_count"), F.count("mask").alias("mask_count"))


@query(
    "split_source_rows",
    f"WITH {SPLIT_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY image) + 1 AS source_row FROM s) SELECT * FROM n WHERE object = 'Brand#12'"
)
def split_source_rows(spark, sf_dir):
    """The split table as one file whose digest is checked, with each row's number in it."""
    path = f"{_scratch(spark)}/split"
    _split_rows(spark, sf_dir).coalesce(1).sortWithinPartitions("image").write.csv(path, header=True, nullValue="", escape='"')
    found = files.byte_manifest(files.read_bytes(spark, path), "asset", "content").where("asset like '%.csv'").first()
    return files.read_split(spark, f"{path}/*.csv", "Brand#12", found["sha256"])


@query("numbered_scan", f"""WITH {SPLIT_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY image) AS k FROM s),
n AS (SELECT * REPLACE (CASE WHEN k % 11 = 0 THEN 'Brand#21/' || k WHEN k % 13 = 0 THEN '../' || k ELSE image END AS image), k + 1 AS source_row FROM r),
d AS (SELECT * FROM n)
SELECT source_row, reason FROM (SELECT source_row, CASE WHEN starts_with(image, '../') THEN 'unsafe_path'
    WHEN NOT starts_with(image, 'Brand#12/') THEN 'outside_category' END AS reason FROM d WHERE object = 'Brand#12' AND k % 17 <> 0
  UNION ALL SELECT source_row, 'malformed' FROM d WHERE k % 17 = 0
  UNION ALL SELECT source_row, 'train_not_normal' FROM d WHERE object = 'Brand#12' AND k % 17 <> 0 AND split = 'train'
    AND label <> 'normal') WHERE reason IS NOT NULL""")
def numbered_scan(spark, sf_dir):
    """A split table as one file with a byte order mark, empty lines and masks that run over lines, read in many splits: what is wrong
    with one category's rows, and with records that can't be read, by record number."""
    base = _scratch(spark)
    k = F.col("k")
    rows = prefix.ordinals(_split_rows(spark, sf_dir).withColumn("one", F.lit(0)), ["one"], ["image"], "k")
    image = F.when(
        k % 11 == 0, F.concat(F.lit("Brand#21/"), k.cast("string"))
    ).when(k % 13 == 0, F.concat(F.lit("../"), k.cast("string"))).otherwise(F.col("image"))
    mask = F.concat(F.lit('"a ""mask""\nof '), k.cast("string"), F.when(k % 5 == 0, F.lit('"')).otherwise(F.lit('\n"')))
    text = F.when(k % 17 == 0, F.concat_ws(",", "object", "split")).otherwise(F.concat_ws(",", "object", "split", "label", image, mask))
    head = F.when(k == 1, F.lit("\ufeffobject,split,label,image,mask\n")).otherwise(F.lit(""))
    lines = rows.select("k", F.concat(head, text, F.when(k % 7 == 0, F.lit("\r\n")).otherwise(F.lit(""))).alias("value"))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{base}/split")
    found = records.csv_records(spark, f"{base}/split", files.SPLIT)
    return records.split_scan_violations(found, "Brand#12").select("source_row", "reason")


@query(
    "reproduction_csv_scan",
    f"WITH {I.SCORES_SQL}, r AS (SELECT method, item, score, row_number() OVER (PARTITION BY method "
    f"ORDER BY item) AS item_order FROM scores) SELECT method, item, score, item_order FROM r WHERE item_order <= 10"
)
def reproduction_csv_scan(spark, sf_dir):
    """The first items of each method written as CSV and scanned, ten of each method and no more."""
    from scoregate.operators.reproduce import first_items

    df = first_items(I.scores(spark, sf_dir), 10).select("method", "item", "score", "item_order")
    path = f"{_scratch(spark)}/reproduction"
    files.write_csv(df, path, ["method", "item"])
    return files.read_exactly(spark, path, df.schema, {m: 10 for m in I.METHODS})


@query("ranked_partition_scan", f"WITH {SELECT_SQL} SELECT category, path, selection_rank FROM sel")
def ranked_partition_scan(spark, sf_dir):
    """The selection written as CSV and scanned with a check that ranks run from 1 in each category."""
    df = seeded_partitions(spark, sf_dir).select("category", "path", "selection_rank")
    path = f"{_scratch(spark)}/partitions"
    files.write_csv(df, path, ["category", "selection_rank"])
    return files.read_ranked(spark, path, df.schema, ["category"], "selection_rank")


@query("json_document", "SELECT lang AS field, count(*) AS row_count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def json_document(spark, sf_dir):
    """Rows by language as one JSON document, written and read again."""
    counts = inv.split_counts(I.table(spark, sf_dir, "documents").where("lang is not null"), ["lang"], "lang")
    path = f"{_scratch(spark)}/document"
    files.write_json(spark, {"rows": {r["lang"]: r["row_count"] for r in counts.collect()}}, path)
    return spark.createDataFrame(sorted(files.read_json(spark, path)["rows"].items()), "field string, row_count long")


@query("opaque_split_sink", f"WITH {OPAQUE_SQL} SELECT asset_id, p_size, path AS source_path, category AS class_label FROM opaque")
def opaque_split_sink(spark, sf_dir):
    """Both sides written to two roots, then joined again on asset_id."""
    base = _scratch(spark)
    partition.write_split(paths(spark, sf_dir), I.KEY, "path", "category", ["p_size"], f"{base}/items", f"{base}/sealed")
    return spark.read.parquet(f"{base}/items").join(spark.read.parquet(f"{base}/sealed"), "asset_id")
