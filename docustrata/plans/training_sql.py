"""DuckDB counterparts of the general training-data queries."""

from __future__ import annotations

from docustrata.plans import sql

_REF = f"""r AS (SELECT DISTINCT id, f AS field_name, k, created_at FROM (SELECT id, 'referenced_code_normalized' AS f, {sql.code('referenced_code_normalized')} AS k, created_at FROM document_references WHERE {sql.code('referenced_code_normalized')} <> ''
UNION ALL SELECT id, 'matched_document_id', matched_document_id, created_at FROM document_references WHERE NOT {sql.blank('matched_document_id')})),
p AS (SELECT 'referenced_code_normalized' AS field_name, normalized_code AS k, min(created_at) AS t FROM document_registry WHERE deleted_at IS NULL GROUP BY 2 UNION ALL SELECT 'matched_document_id', document_id, min(created_at) FROM document_registry WHERE deleted_at IS NULL GROUP BY 2),
j AS (SELECT r.*, NOT coalesce(p.t <= r.created_at, false) AS o FROM r LEFT JOIN p USING (field_name, k))"""
_STEPS = """a AS (SELECT field_name, k, created_at, deleted_at FROM (SELECT 'referenced_code_normalized' AS field_name, normalized_code AS k, created_at, deleted_at FROM document_registry UNION SELECT 'matched_document_id', document_id, created_at, deleted_at FROM document_registry) WHERE k IS NOT NULL AND created_at IS NOT NULL),
lh AS (SELECT CAST(min(t) AS DATE) AS low, max(t) AS high FROM (SELECT created_at AS t FROM r UNION ALL SELECT created_at FROM a)), cu AS (SELECT low + CAST(i * ceil((CAST(high AS DATE) - low + 1) / 8) AS INT) AS c FROM lh, range(1, 8) g(i)),
sn AS (SELECT strftime(c, '%Y-%m-%d') AS as_of, CAST(c AS TIMESTAMP) AS t FROM cu, lh WHERE c <= high UNION ALL SELECT 'end', NULL),
fl AS (SELECT as_of, field_name, k, min(created_at) AS first FROM sn, a WHERE (t IS NULL OR created_at < t) AND (deleted_at IS NULL OR (t IS NOT NULL AND deleted_at >= t)) GROUP BY 1, 2, 3), w AS (SELECT as_of, r.* FROM sn, r WHERE t IS NULL OR created_at < t)"""
_SNAP = """l AS (SELECT document_id, snapshot_date, nullif(lower(trim(status_normalized, ' ' || chr(9) || chr(10) || chr(13))), '') AS s, current_version_id AS v, text_actualized_at AS a,
row_number() OVER (PARTITION BY document_id, snapshot_date ORDER BY loaded_at DESC NULLS LAST, nullif(lower(trim(status_normalized, ' ' || chr(9) || chr(10) || chr(13))), '') DESC NULLS LAST, current_version_id DESC NULLS LAST, text_actualized_at DESC NULLS LAST) AS k FROM document_snapshots WHERE document_id IS NOT NULL AND snapshot_date IS NOT NULL),
m AS (SELECT *, row_number() OVER w = 1 OR lag(s) OVER w IS DISTINCT FROM s OR lag(v) OVER w IS DISTINCT FROM v OR lag(a) OVER w IS DISTINCT FROM a AS n FROM l WHERE k = 1 WINDOW w AS (PARTITION BY document_id ORDER BY snapshot_date)),
g AS (SELECT *, sum(CAST(n AS INT)) OVER (PARTITION BY document_id ORDER BY snapshot_date) AS i FROM m), u AS (SELECT document_id, i, any_value(s) AS s, any_value(v) AS v, any_value(a) AS a, min(snapshot_date) AS f, count(*) AS c FROM g GROUP BY 1, 2),
h AS (SELECT *, lead(f) OVER (PARTITION BY document_id ORDER BY i) AS x FROM u)"""
_TREE = """d AS (SELECT id, min(nullif(CASE WHEN trim(parent_node_id, ' ' || chr(9) || chr(10)) = '' THEN NULL ELSE parent_node_id END, '')) AS p FROM document_nodes WHERE id IS NOT NULL GROUP BY 1), e AS (SELECT d.id, q.id AS p FROM d LEFT JOIN d q ON q.id = d.p),
t AS (SELECT id, id AS root, 0 AS depth FROM e WHERE p IS NULL UNION ALL SELECT e.id, t.root, t.depth + 1 FROM t JOIN e ON e.p = t.id)"""

_TR = lambda x: f"trim({x}, ' ')"
_PATHS = f"""v AS (SELECT id, min(struct_pack(a := version_id, b := order_index, c := CASE WHEN {sql.blank('parent_node_id')} THEN NULL ELSE parent_node_id END, l := CASE WHEN nullif({_TR('title')}, '') IS NOT NULL THEN concat_ws(' ', nullif({_TR('label')}, ''), nullif({_TR('title')}, '')) WHEN node_type = 'title' THEN {_TR('text')} END)) AS m, min(heading_path) AS heading_path FROM document_nodes WHERE id IS NOT NULL GROUP BY 1),
d AS (SELECT id, m.c AS p, nullif(m.l, '') AS l, heading_path FROM v), e AS (SELECT d.id, q.id AS p, d.l FROM d LEFT JOIN d q ON q.id = d.p),
t AS (SELECT id, id AS root, 0 AS depth, coalesce(l, '') AS path FROM e WHERE p IS NULL UNION ALL SELECT e.id, t.root, t.depth + 1, concat_ws(' > ', nullif(t.path, ''), e.l) FROM t JOIN e ON e.p = t.id)"""
_BELOW = "w AS (SELECT id AS ancestor_id, id FROM t UNION ALL SELECT ancestor_id, e.id FROM w JOIN e ON e.p = w.id)"

ORACLES = {
    "p1_found": f"WITH {_REF} SELECT DISTINCT id AS reference_id, field_name FROM j WHERE o",
    "p1_counts": f"WITH {_REF} SELECT field_name, strftime(created_at, '%Y-%m') AS period, count(*) AS n_references, count(*) FILTER (WHERE o) AS n_orphans FROM j GROUP BY 1, 2",
    "p1_snapshots": f"WITH {_REF}, {_STEPS} SELECT as_of, field_name, strftime(created_at, '%Y-%m') AS period, count(*) AS n_references, count(*) FILTER (WHERE NOT coalesce(first <= created_at, false)) AS n_orphans FROM w LEFT JOIN fl USING (as_of, field_name, k) GROUP BY 1, 2, 3",
    "p2_found": f"WITH {_SNAP} SELECT document_id, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(x, '%Y-%m-%d'), '9999-12-31') AS valid_to FROM h",
    "p2_history": f"WITH {_SNAP} SELECT document_id, s AS status_normalized, v AS current_version_id, a AS text_actualized_at, f AS valid_from, coalesce(x, DATE '9999-12-31') AS valid_to, c AS n_snapshots, x IS NULL AS is_current FROM h",
    "p5_found": f"WITH RECURSIVE {_TREE} SELECT d.id AS node_id, coalesce(t.root, '') AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS tree_depth FROM d LEFT JOIN t USING (id)",
    "p5_paths": f"WITH RECURSIVE {_PATHS} SELECT id AS node_id, coalesce(root, '') AS root_id, CAST(coalesce(depth, -1) AS INT) AS tree_depth, path, heading_path, CASE WHEN root IS NULL THEN 'cyclic' WHEN heading_path IS NULL THEN 'missing' WHEN heading_path = path THEN 'equal' ELSE 'differs' END AS stored_path FROM d LEFT JOIN t USING (id)",
    "p5_descendants": f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT ancestor_id, id AS node_id FROM w WHERE ancestor_id <> id",
    "p5_intervals": f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT ancestor_id AS node_id, count(*) - 1 AS n_descendants, 2 * count(*) - 1 AS span FROM w GROUP BY 1",
}
