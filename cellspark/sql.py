"""DuckDB SQL for the queries of :mod:`cellspark.queries`, over the same tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

#: The stand-ins: values, obs, genes, edges of the ontology.
BASE = """
vals AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
obs AS (SELECT o_orderkey AS cell, c_nationkey AS artifact, o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment
        FROM orders JOIN customer ON o_custkey = c_custkey),
owned AS (SELECT vals.*, artifact FROM vals JOIN obs USING (cell)),
var AS (SELECT DISTINCT artifact, gene FROM owned),
genes AS (SELECT p_partkey AS gene, p_name AS symbol, p_type AS organism, p_brand AS brand FROM part),
onto AS (SELECT 'N:' || n_nationkey AS child, 'R:' || n_regionkey AS parent, n_name AS name FROM nation
         UNION ALL SELECT 'R:' || r_regionkey, 'ROOT', r_name FROM region),
up AS (SELECT child, parent AS ancestor FROM onto UNION SELECT a.child, b.parent FROM onto a JOIN onto b ON a.parent = b.child),
terms AS (SELECT DISTINCT 'N:' || c_nationkey AS term FROM customer UNION ALL SELECT 'R:1'),
used AS (SELECT up.* FROM up JOIN terms ON child = term),
leafs AS (SELECT term FROM terms WHERE term NOT IN (SELECT ancestor FROM used)),
grp AS (SELECT ancestor, child AS leaf FROM used WHERE child IN (SELECT term FROM leafs)),
hier AS (SELECT value, (row_number() OVER (ORDER BY up, new, value) - 1)::INT AS code FROM (
           SELECT coalesce(t.term, a.ancestor) AS value, (a.ancestor IS NOT NULL)::INT AS up, (t.term IS NULL)::INT AS new
           FROM terms t FULL JOIN (SELECT DISTINCT ancestor FROM used) a ON t.term = a.ancestor)
         UNION ALL SELECT 'unknown', -1),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY artifact) - 1 AS storage_idx, row_number() OVER (PARTITION BY artifact ORDER BY cell) - 1 AS obs_idx,
                row_number() OVER (ORDER BY artifact, cell) - 1 AS global_idx FROM obs),
met AS (SELECT cell, total, n, top, mt, ribo FROM (
          SELECT cell, sum(value) AS total, count(*) AS n, sum(CASE WHEN organism = 'SMALL' THEN value ELSE 0 END) AS mt,
                 sum(CASE WHEN brand = 'Brand#11' THEN value ELSE 0 END) AS ribo,
                 list_sum(list_sort(list(value), 'DESC')[1:20]) AS top
          FROM vals LEFT JOIN genes USING (gene) GROUP BY cell)),
near AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS distance
         FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM near) WHERE rank <= 6)
"""


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0)"


def with_base(sql: str, more: str = "") -> str:
    return f"WITH {BASE}{more} {sql}"


def add(name: str, sql: str, more: str = "") -> None:
    ORACLE_SQL[name] = with_base(sql, more)


add("scan_union_index", "SELECT cell, storage_idx, obs_idx, global_idx FROM numbered")
add("obs_filter", "SELECT artifact, count(*) AS n, min(cell) AS first_cell FROM obs WHERE priority IN ('1-URGENT', '2-HIGH') AND status = 'F' GROUP BY artifact")
add(
    "block_split",
    "SELECT artifact, floor(obs_idx / block)::BIGINT AS block_id, count(*) AS n FROM numbered JOIN size USING (artifact) GROUP BY ALL",
    ", size AS (SELECT artifact, floor(ceil(n / 10) * 10 / CASE WHEN n * 100 > 2000 THEN ceil(n * 100 / 1000) ELSE 1 END) AS block FROM (SELECT artifact, count(*) AS n FROM obs GROUP BY artifact))",
)
add("slice_artifacts", "SELECT n_name, n_nationkey AS ordinal FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 12")
add("version_diff", "SELECT DISTINCT p_brand AS key FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)")
add("var_inner_join", "SELECT gene FROM var GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT artifact) FROM var)")
add("var_outer_join", "SELECT gene, count(*) AS n_artifacts FROM var GROUP BY gene")
add(
    "gene_vocab_flags",
    """SELECT gene_id, symbol, 'o1' AS organism, symbol LIKE 'MT-%' AS mt, symbol LIKE 'RPS%' OR symbol LIKE 'RPL%' AS ribo, regexp_matches(symbol, '^HB[^(P)]') AS hb,
       (row_number() OVER (ORDER BY gene_id) - 1)::INT AS pos, 0 AS start_idx
FROM (SELECT p_name AS gene_id, min(CASE WHEN p_size % 10 = 1 THEN 'MT-HB' || p_size WHEN p_size % 10 = 2 THEN 'RPSHB' || p_size ELSE 'HB' || p_size END) AS symbol FROM part GROUP BY p_name)""",
)
add("gene_positions", "SELECT gene, organism, pos, min(pos) OVER (PARTITION BY organism) AS start_idx FROM (SELECT *, (row_number() OVER (ORDER BY organism, gene) - 1)::INT AS pos FROM genes)")
add(
    "unseen_genes",
    "SELECT artifact, gene FROM (SELECT DISTINCT artifact FROM seen), brand WHERE (artifact, gene) NOT IN (SELECT artifact, gene FROM seen)",
    ", brand AS (SELECT gene FROM genes WHERE brand = 'Brand#11'), seen AS (SELECT artifact, gene FROM var JOIN brand USING (gene))",
)
add(
    "join_vocabulary",
    "SELECT artifact, gene_id, var_idx FROM (SELECT artifact, 'G' || gene % 500 AS gene_id, min(gene) AS var_idx FROM var GROUP BY ALL) WHERE gene_id IN (SELECT 'G' || gene FROM genes WHERE gene < 300)",
)
add("vars_sorted", "SELECT artifact, artifact >= 5 OR count(*) = 1 AS is_sorted FROM var GROUP BY artifact")
add(
    "vars_aligned",
    "SELECT artifact, count(*) AS n_genes, count(*) FILTER (organism = 'LARGE') AS n_outside, count(*) FILTER (organism = 'LARGE') = 0 AS aligned FROM var JOIN genes USING (gene) GROUP BY artifact",
)
add("merged_categories", "SELECT DISTINCT priority AS value FROM obs")
add("encode_labels", "SELECT priority, CASE WHEN priority = '3-MEDIUM' THEN -1 ELSE (dense_rank() OVER (ORDER BY priority = '3-MEDIUM', priority) - 1)::INT END AS code, count(*) AS n FROM obs GROUP BY priority")
add("decode_labels", "SELECT (dense_rank() OVER (ORDER BY status) - 1)::INT AS code, status AS value, count(*) AS n FROM obs GROUP BY status")
add("combined_label_codes", "SELECT cell, (dense_rank() OVER (ORDER BY priority, segment) - 1)::INT AS code FROM obs")
add(
    "label_weights",
    "SELECT label, n, round((max(n) OVER () / 10.0) / (1 + n - min(n) OVER () + max(n) OVER () / 10.0), 9) AS weight FROM c",
    ", c AS (SELECT priority || '__' || status AS label, count(*) AS n FROM obs GROUP BY ALL)",
)
add("class_weights", "SELECT segment, count(*) AS n, round(50.0::DOUBLE * count(*) / (count(*) + 50.0::DOUBLE), 9) AS weight FROM obs GROUP BY segment")
add(
    "class_index_offsets",
    "SELECT priority, cell, (row_number() OVER (PARTITION BY priority ORDER BY cell) - 1)::INT AS pos, \"offset\" FROM obs JOIN o USING (priority)",
    ", o AS (SELECT priority, (sum(count(*)) OVER (ORDER BY priority) - count(*))::BIGINT AS \"offset\" FROM obs GROUP BY priority)",
)
add("artifact_gene_lists", "SELECT artifact, count(*) AS n_vars, md5(string_agg(gene::VARCHAR, ',' ORDER BY gene)) AS genes_md5 FROM var GROUP BY artifact")
add("merge_only_genes", "SELECT coalesce(p_partkey, l_partkey) AS gene, p_size AS size, n AS n_cells FROM part FULL JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey")
add(
    "growing_index",
    """SELECT cell, storage_idx, obs_idx, global_idx, split, label::INT AS label, pos, "offset" FROM sides LEFT JOIN (
  SELECT global_idx, row_number() OVER (PARTITION BY priority ORDER BY global_idx) - 1 AS pos, label, "offset" FROM sides JOIN cl USING (priority) WHERE split = 'train') USING (global_idx)""",
    """, came AS (SELECT obs.*, row_number() OVER (ORDER BY n_regionkey, artifact, cell) - 1 AS global_idx, dense_rank() OVER (ORDER BY n_regionkey, artifact) - 1 AS storage_idx,
    row_number() OVER (PARTITION BY artifact ORDER BY cell) - 1 AS obs_idx FROM obs JOIN nation ON artifact = n_nationkey),
sides AS (SELECT *, CASE WHEN """ + uniform("'42t#' || artifact") + " < 0.1 THEN 'test' WHEN " + uniform("'42v#' || artifact || '#' || cell") + """ < 0.2 THEN 'validation' ELSE 'train' END AS split FROM came),
cl AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS label, (sum(count(*)) OVER (ORDER BY priority) - count(*))::BIGINT AS "offset" FROM sides WHERE split = 'train' GROUP BY priority)""",
)
add("value_counts_pct", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM events GROUP BY event_type")
add("top_labels", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 3")
add("null_counts", "SELECT 'a' AS \"column\", count(*) FILTER (l_quantity <= 40) AS n_null FROM lineitem UNION ALL SELECT 'b', count(*) FILTER (l_returnflag = 'A') FROM lineitem")
add(
    "cell_qc_metrics",
    """SELECT cell, round(total, 6) AS total_counts, round(ln(1 + total), 6) AS log1p_total_counts, n AS n_genes_by_counts, round(ln(1 + n), 6) AS log1p_n_genes_by_counts,
       round(100 * top / total, 6) AS pct_counts_in_top_20_genes, mt AS total_counts_mt, round(100 * mt / total, 6) AS pct_counts_mt, ribo AS total_counts_ribo, round(100 * ribo / total, 6) AS pct_counts_ribo FROM met""",
)
add(
    "gene_qc_metrics",
    "SELECT gene, count(*) AS n_cells_by_counts, sum(value) AS total_counts, round(sum(value) / (SELECT count(*) FROM orders), 6) AS mean_counts, round(100 * (1 - count(*) / (SELECT count(*) FROM orders)), 6) AS pct_dropout_by_counts FROM vals GROUP BY gene",
)
add(
    "mad_outliers",
    """SELECT cell, abs(total - (SELECT median(total) FROM m)) > 2 * (SELECT mad(total) FROM m) OR abs(n - (SELECT median(n) FROM m)) > 2 * (SELECT mad(n) FROM m)
       OR abs(pt - (SELECT median(pt) FROM m)) > 2 * (SELECT mad(pt) FROM m) AS outlier,
       abs(pm - (SELECT median(pm) FROM m)) > (SELECT mad(pm) FROM m) OR pm > 90 AS mt_outlier FROM m""",
    ", m AS (SELECT *, 100 * top / total AS pt, 100 * mt / total AS pm FROM met)",
)
add(
    "filter_cells_genes",
    "SELECT * FROM k WHERE cell IN (SELECT cell FROM k GROUP BY cell HAVING sum(value) >= 60 AND count(*) >= 3)",
    ", k AS (SELECT * FROM vals WHERE gene IN (SELECT gene FROM vals GROUP BY gene HAVING sum(value) >= 500))",
)
add(
    "dataset_gates",
    "SELECT artifact, CASE WHEN reason IS NULL THEN 'kept' ELSE 'dropped' END AS status, reason FROM r",
    """, st AS (SELECT artifact, count(*) AS n_before, count(*) FILTER (status = 'F') AS n_cells, count(*) FILTER (priority = '1-URGENT') AS n_primary FROM obs GROUP BY artifact),
vg AS (SELECT artifact, count(*) AS n_genes FROM var GROUP BY artifact),
r AS (SELECT artifact, CASE WHEN n_primary = 0 THEN 'no primary cells' WHEN artifact = 3 THEN 'assay' WHEN artifact % 4 = 3 THEN 'organism' WHEN n_genes < 500 THEN 'genes'
             WHEN n_cells < 100 THEN 'cells' WHEN n_before / (n_cells + 1) > 2.05 THEN 'dropped cells' WHEN n_genes - 10 < 520 THEN 'valid genes' END AS reason FROM st JOIN vg USING (artifact))""",
)
add("raw_count_check", "SELECT l_suppkey AS artifact, sum(abs(v - trunc(v))) = 0 AS is_raw FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_discount ELSE l_quantity END AS v FROM lineitem) GROUP BY ALL")
add(
    "log1p_check",
    "SELECT l_suppkey AS artifact, NOT (max(v) > 30 OR min(v) < 0 OR coalesce(min(v) FILTER (v > 0), 0) >= 1) AS is_log1p FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN l_discount ELSE l_quantity END AS v FROM lineitem) GROUP BY ALL",
)
add(
    "validate_obs",
    """SELECT 'duplicate' AS problem, 'cell' AS "column", (c_custkey % 1000)::VARCHAR AS value, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unknown id', 'place_id', 'N:' || c_nationkey * 2, count(*) FROM customer WHERE c_nationkey * 2 > 24 GROUP BY ALL
UNION ALL SELECT 'missing column', 'gone', NULL, 0""",
)
add("normalize_log1p", "SELECT cell, gene, round(ln(1 + value * 10000 / total), 6) AS norm FROM vals JOIN met USING (cell)")
add("length_normalize", "SELECT cell, gene, round(value / CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END, 6) AS value FROM vals JOIN part ON gene = p_partkey")
add("depth_norm_log2", "SELECT cell, gene, total AS depth, round(log2(1 + value * 10000 / total), 6) AS value FROM vals JOIN met USING (cell)")
add(
    "revert_to_raw",
    "SELECT cell, (row_number() OVER (PARTITION BY cell ORDER BY gene) - 1)::INT AS i, round_even(x / min(x) OVER (PARTITION BY cell), 0) AS raw FROM (SELECT cell, gene, pow(2.0, log2(value + 1) / 3) - 1 AS x FROM vals)",
)
add(
    "quantile_bins",
    "SELECT cell, gene, len(list_filter(e, lambda b: b <= value)) AS bin FROM vals JOIN q USING (cell)",
    ", q AS (SELECT cell, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS e FROM vals GROUP BY cell)",
)
add("topk_genes", "SELECT * FROM (SELECT cell, (row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) - 1)::INT AS rank, gene, value FROM vals) WHERE rank < 3")
add("random_genes", "SELECT * FROM (SELECT cell, (row_number() OVER (PARTITION BY cell ORDER BY md5('7#' || cell || '#' || gene)) - 1)::INT AS rank, gene FROM vals) WHERE rank < 2")
add(
    "zero_fill_genes",
    "SELECT cell, (row_number() OVER (PARTITION BY cell ORDER BY i) - 1)::INT AS rank, pos FROM (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY cell ORDER BY i) <= 5)",
    f""", taken AS (SELECT DISTINCT cell, (gene % 50)::INT AS pos FROM vals),
drawn AS (SELECT cell, i, floor({uniform("'3#' || cell || '#' || i")} * 50)::INT AS pos FROM (SELECT DISTINCT cell FROM vals), range(1, 65) r(i)),
first AS (SELECT cell, pos, min(i) AS i FROM drawn ANTI JOIN taken USING (cell, pos) GROUP BY cell, pos)""",
)
add("ontology_ancestors", "SELECT child, ancestor FROM up")
add("ontology_descendants", "SELECT child AS descendant FROM up WHERE ancestor = 'R:2'")
add("ancestry_groupings", "SELECT ancestor, leaf FROM grp")
add("hierarchy_encoder", "SELECT value, code FROM hier")
add("labels_hierarchy", "SELECT a.code AS ancestor_code, l.code AS leaf_code FROM grp JOIN hier a ON a.value = ancestor JOIN hier l ON l.value = leaf")
add(
    "translate_ids",
    "SELECT c_custkey, 'N:' || c_nationkey || ', R:' || c_custkey % 6 AS ids, n_name || ',' || r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = c_custkey % 6",
)
add(
    "age_roll_up",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_nationkey = 7 THEN 'old' WHEN n_regionkey = 0 THEN 'young' WHEN n_regionkey = 3 THEN 'adult' ELSE 'unknown' END
       WHEN 1 THEN CASE WHEN c_nationkey = 7 THEN 'old' ELSE 'unknown' END END AS age_group FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
add("drop_assays", "SELECT 'EFO:' || substr(priority, 1, 1) AS assay, count(*) AS n FROM obs WHERE substr(priority, 1, 1) NOT IN ('3', '5') GROUP BY ALL")
add(
    "split_train_val_test",
    """SELECT cell, CASE WHEN held THEN 'test' WHEN row_number() OVER (PARTITION BY held ORDER BY md5('42#' || global_idx), global_idx) - 1 < floor(total * 0.2) THEN 'validation' ELSE 'train' END AS split
FROM numbered JOIN h USING (artifact)""",
    """, sz AS (SELECT artifact, count(*) AS n FROM obs GROUP BY artifact),
h AS (SELECT artifact, sum(n) OVER () AS total, sum(n) OVER o <= floor(sum(n) OVER () * 0.15) OR row_number() OVER o = 1 AS held FROM sz WINDOW o AS (ORDER BY md5('42#' || artifact), artifact))""",
)
add("shuffled_index", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('11#' || o_orderkey), o_orderkey) - 1 AS shuffled FROM orders")
add("nnz_sigmoid_weight", "SELECT cell, round(1 + 999.0::DOUBLE / (1 + exp((n * 300 - 2000) * -0.003::DOUBLE)), 9) AS weight FROM met")

_CLASSES = """, w0 AS (SELECT priority AS label, 50.0::DOUBLE * count(*) / (count(*) + 50.0::DOUBLE) AS w FROM obs GROUP BY priority),
lab AS (SELECT label, w, CASE WHEN row_number() OVER (ORDER BY label DESC) = 1 THEN 1.0::DOUBLE ELSE sum(w) OVER (ORDER BY label) / sum(w) OVER () END AS hi FROM {w}),
ivl AS (SELECT label, coalesce(lag(hi) OVER (ORDER BY label), 0) AS lo, hi FROM lab)"""


def _draws(n: int, seed: int) -> str:
    return f", drawn AS (SELECT draw_id, label FROM (SELECT i AS draw_id, {uniform(f"'{seed}#' || i")} AS u FROM range({n}) r(i)) JOIN ivl ON u >= lo AND u < hi)"


add("sample_labels", "SELECT draw_id, label FROM drawn", _CLASSES.format(w="w0") + _draws(20_000, 5))
add(
    "sample_labels_curriculum",
    "SELECT label, count(*) AS n FROM drawn GROUP BY label",
    _CLASSES.format(w="(SELECT label, pow(w, 0.4::DOUBLE) AS w FROM w0)") + _draws(5000, 6),
)
add(
    "sample_rows_uniform",
    "SELECT draw_id, d.label, cell FROM (SELECT draw_id, label, floor(" + uniform("'5r#' || draw_id") + " * n)::BIGINT AS pos FROM drawn JOIN sz USING (label)) d JOIN ix USING (label, pos)",
    _CLASSES.format(w="w0") + _draws(5000, 5) + ", sz AS (SELECT priority AS label, count(*) AS n FROM obs GROUP BY priority), ix AS (SELECT priority AS label, cell, row_number() OVER (PARTITION BY priority ORDER BY cell) - 1 AS pos FROM obs)",
)
add(
    "sample_rows_weighted",
    "SELECT draw_id, d.label, cell FROM (SELECT *, " + uniform("'9w#' || draw_id") + " AS u FROM drawn) d JOIN laid ON d.label = laid.label AND u >= laid.lo AND u < laid.hi",
    _CLASSES.format(w="w0") + _draws(3000, 9) + """, cum AS (SELECT priority AS label, cell, sum(cell % 7) OVER (PARTITION BY priority ORDER BY cell)::DOUBLE / sum(cell % 7) OVER (PARTITION BY priority)::DOUBLE AS hi FROM obs WHERE cell % 7 > 0),
laid AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY label ORDER BY cell), 0) AS lo FROM cum)""",
)
add(
    "sample_rows_weighted_wor",
    "SELECT * FROM (SELECT priority AS label, cell, row_number() OVER (PARTITION BY priority ORDER BY -ln(greatest(" + uniform("'4#' || cell") + ", pow(2.0::DOUBLE, -53))) / (cell % 7), cell)::INT AS rank FROM obs WHERE cell % 7 > 0) WHERE rank <= 200",
)
add("restrict_topk", "SELECT label, cell FROM (SELECT o_orderpriority AS label, o_orderkey AS cell, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 100")
add("rank_shard", "SELECT cell, global_idx FROM numbered, (SELECT count(*) AS n FROM obs) WHERE global_idx >= 10 + ceil(n / 3) AND global_idx < least(2 * ceil(n / 3), n)")
add("knn6", "SELECT src, dst, rank::INT AS rank, round(distance, 5) AS distance FROM knn")
add(
    "nearest_edges",
    "SELECT src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d <= 1e-6, d, dst)::INT AS rank FROM (SELECT l_orderkey AS src, l_partkey AS dst, min(l_quantity) - 1 AS d FROM lineitem GROUP BY ALL)) WHERE rank <= 3",
)
add(
    "metacell_sum",
    """SELECT cell, gene, sum(value) AS value FROM (SELECT * FROM vals UNION ALL
SELECT src + 1, gene, value FROM knn JOIN vals ON cell = dst + 1 WHERE """
    + uniform("'2#' || (src + 1)")
    + " < 0.5) GROUP BY cell, gene",
)
add(
    "knn_emit",
    """SELECT src + 1 AS cell, (row_number() OVER (PARTITION BY src ORDER BY rank) - 1)::INT AS n, total AS depth FROM knn JOIN met ON cell = dst + 1
WHERE src + 1 IN (SELECT cell FROM vals)""",
)
_MEANS = ", cm AS (SELECT segment AS cluster, gene, sum(value) / any_value(n) AS mean FROM vals JOIN obs USING (cell) JOIN (SELECT segment, count(*) AS n FROM obs GROUP BY segment) USING (segment) GROUP BY ALL)"
add("cluster_means", "SELECT cluster, gene, round(mean, 9) AS mean FROM cm", _MEANS)
add(
    "cluster_corr",
    "SELECT a, b, round(corr(x, y), 9) AS corr FROM (SELECT p.a, p.b, coalesce(m1.mean, 0) AS x, coalesce(m2.mean, 0) AS y FROM pr p JOIN genes g ON TRUE LEFT JOIN cm m1 ON m1.cluster = p.a AND m1.gene = g.gene LEFT JOIN cm m2 ON m2.cluster = p.b AND m2.gene = g.gene) GROUP BY a, b",
    _MEANS + ", cl AS (SELECT DISTINCT segment AS c FROM obs), pr AS (SELECT x.c AS a, y.c AS b FROM cl x JOIN cl y ON x.c < y.c)",
)
add(
    "cluster_relabel",
    "SELECT cell_type, cluster, n, CASE WHEN r = 0 OR n < 10 THEN cell_type ELSE cell_type || '_' || r END AS name FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY n DESC, cluster) - 1 AS r FROM k)",
    ", k AS (SELECT status AS cell_type, priority || artifact AS cluster, count(*) AS n FROM obs GROUP BY ALL)",
)
add(
    "cluster_merge",
    "SELECT s.cluster, coalesce(f.into_, s.into_) AS \"into\" FROM step s LEFT JOIN step f ON s.into_ = f.cluster",
    """, mm AS (SELECT a, avg(n) AS m FROM (SELECT o_orderpriority AS a, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY a),
step AS (SELECT y.a AS cluster, min(x.a) AS into_ FROM mm x JOIN mm y ON x.a < y.a AND (x.a < '4') = (y.a < '4') WHERE 1 - abs(x.m - y.m) > 0.9 GROUP BY y.a)""",
)
add("batch_label", "SELECT concat_ws(',', nullif(segment, 'BUILDING'), status) AS batches, count(*) AS n FROM obs GROUP BY ALL")
add(
    "obs_remap",
    """SELECT cell, CASE WHEN artifact % 5 = 0 THEN 'unknown' ELSE 'E:1' END AS eth, status AS ct, CASE WHEN cell % 7 = 0 THEN 'unknown' ELSE 'U' END AS ti,
       CASE WHEN cell % 3 = 0 OR (cell % 4 = 0 AND cell % 7 <> 0) THEN 'True' ELSE 'False' END AS cell_culture FROM obs""",
)
add(
    "age_ladder",
    """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'a' WHEN p_size % 11 = 0 THEN NULL WHEN p_size * 2 > 80 THEN 's80' WHEN p_size * 2 > 60 THEN 's60' WHEN p_size * 2 > 40 THEN 's40'
       WHEN p_size * 2 > 20 THEN 's20' WHEN p_size * 2 < 4 THEN 'infant' ELSE 'child' END AS stage FROM part""",
)
add("replace_values", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE lower(c_mktsegment) END AS c_mktsegment FROM customer")

_SMALL = ", sm AS (SELECT gene, (row_number() OVER (ORDER BY organism, gene) - 1)::INT AS pos, organism FROM genes), own AS (SELECT cell, pos, value FROM vals JOIN sm USING (gene) WHERE organism = 'SMALL')"
add(
    "collate_batch",
    """SELECT m.cell, j.i, CASE WHEN r.value > 0 THEN r.pos END AS gene, coalesce(round(log2(1 + r.value * 10000 / total), 6), 0) AS x, substr(priority, 1, 1)::INT AS code, total AS depth
FROM met m JOIN obs o ON o.cell = m.cell JOIN (SELECT unnest([0, 1, 2]) AS i) j ON TRUE
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, pos) - 1 AS i FROM own) r ON r.cell = m.cell AND r.i = j.i""",
    _SMALL,
)
add(
    "collate_random",
    """SELECT m.cell, 3 AS width, 3 AS n_genes, coalesce(sum(r.value), 0) AS total FROM met m LEFT JOIN (
SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('1#' || cell || '#' || (pos - (SELECT min(pos) FROM sm WHERE organism = 'SMALL')))) AS i FROM own) r ON r.cell = m.cell AND i <= 2 GROUP BY m.cell""",
    _SMALL,
)
add(
    "collate_binned",
    """SELECT m.cell, j.i, coalesce(len(list_filter(e, lambda b: b <= r.value)), 0) AS bin FROM met m JOIN (SELECT unnest([0, 1, 2, 3]) AS i) j ON TRUE
LEFT JOIN top4 r ON r.cell = m.cell AND r.i = j.i LEFT JOIN q ON q.cell = m.cell""",
    _SMALL
    + """, top4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, pos) - 1 AS i FROM own) WHERE i < 4),
sorted AS (SELECT cell, list(value ORDER BY value) AS s FROM top4 GROUP BY cell),
steps AS (SELECT cell, s, i, (len(s) - 1) * (i / 3.0::DOUBLE) AS p FROM sorted, (SELECT unnest([0, 1, 2, 3]) AS i)),
q AS (SELECT cell, list(s[floor(p)::INT + 1] + (s[least(floor(p)::INT + 2, len(s))] - s[floor(p)::INT + 1]) * (p - floor(p))) AS e FROM steps GROUP BY cell)""",
)
add(
    "collate_all",
    """SELECT m.cell, (SELECT count(*) FROM genes WHERE organism = 'SMALL')::INT AS width, coalesce(sum(value), 0) AS total,
       coalesce(min(pos) FILTER (value = 50) - (SELECT min(pos) FROM sm WHERE organism = 'SMALL') + 1, 0)::INT AS first_50
FROM met m LEFT JOIN own USING (cell) GROUP BY m.cell""",
    _SMALL,
)
add(
    "collate_neighbours",
    """SELECT cell, (i - 1)::INT AS i, pos AS gene, coalesce(total, 0) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value + near / 6.0::DOUBLE DESC, pos) AS i FROM b) LEFT JOIN met USING (cell) WHERE i <= 2""",
    _SMALL
    + """, e AS (SELECT src + 1 AS src, dst + 1 AS dst FROM knn),
b AS (SELECT cell, pos, sum(value) AS value, sum(near) AS near FROM (
        SELECT cell, pos, value, 0.0::DOUBLE AS near FROM own WHERE cell IN (SELECT src FROM e)
        UNION ALL SELECT src, pos, 0.0::DOUBLE, value FROM e JOIN own ON own.cell = dst) GROUP BY ALL)""",
)
add("join_vocabulary_whole", "SELECT artifact, 'G' || gene AS gene_id, gene AS var_idx FROM var JOIN genes USING (gene)")
_WIDTH = ", base AS (SELECT min(pos) AS low, count(*) AS width FROM sm WHERE organism = 'SMALL')"
add(
    "zero_fill_genes_organism",
    "SELECT cell, (row_number() OVER (PARTITION BY cell ORDER BY i) - 1)::INT AS rank, pos FROM (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY cell ORDER BY i) <= 5)",
    _SMALL
    + _WIDTH
    + f""", taken AS (SELECT cell, (pos - low)::INT AS pos FROM own, base),
drawn AS (SELECT cell, i, floor({uniform("'3#' || cell || '#' || i")} * width)::INT AS pos FROM (SELECT DISTINCT cell FROM vals), base, range(1, 65) r(i)),
first AS (SELECT cell, pos, min(i) AS i FROM drawn ANTI JOIN taken USING (cell, pos) GROUP BY cell, pos)""",
)
add(
    "collate_neighbours_filled",
    """SELECT cell, i::INT AS i, gene::INT AS gene, coalesce(total, 0) AS depth FROM (
    SELECT cell, i - 1 AS i, pos AS gene FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value + near / 6.0::DOUBLE DESC, pos) AS i FROM b) WHERE i <= 2
    UNION ALL SELECT cell, coalesce(n, 0) + r - 1, pos + low FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY i) AS r FROM first) LEFT JOIN have USING (cell), base WHERE r <= 2 - coalesce(n, 0)
) LEFT JOIN met USING (cell)""",
    _SMALL
    + _WIDTH
    + f""", e AS (SELECT src + 1 AS src, dst + 1 AS dst FROM knn),
b AS (SELECT cell, pos, sum(value) AS value, sum(near) AS near FROM (
        SELECT cell, pos, value, 0.0::DOUBLE AS near FROM own WHERE cell IN (SELECT src FROM e)
        UNION ALL SELECT src, pos, 0.0::DOUBLE, value FROM e JOIN own ON own.cell = dst) GROUP BY ALL),
have AS (SELECT cell, count(*) AS n FROM b GROUP BY cell),
every AS (SELECT cell FROM vals WHERE cell IN (SELECT src FROM e) UNION SELECT src FROM e JOIN vals ON vals.cell = dst),
drawn AS (SELECT cell, i, floor({uniform("'0#' || cell || '#' || i")} * width)::INT AS pos FROM every, base, range(1, 65) r(i)),
first AS (SELECT cell, pos, min(i) AS i FROM drawn ANTI JOIN (SELECT cell, (pos - low)::INT AS pos FROM b, base) USING (cell, pos) GROUP BY cell, pos)""",
)
add(
    "collate_knn_cells",
    """SELECT cell, cell % 7 AS dataset, (i - 1)::INT AS i, pos AS gene, (SELECT coalesce(sum(o.value), 0) FROM e JOIN own o ON o.cell = e.dst AND o.pos = p.pos WHERE e.src = p.cell) AS near
FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, pos) AS i FROM own) p WHERE i <= 2 AND cell IN (SELECT src FROM e JOIN vals ON vals.cell = e.dst)""",
    _SMALL + ", e AS (SELECT src + 1 AS src, dst + 1 AS dst FROM knn)",
)
add("primary_cells", "SELECT artifact, count(*) AS n FROM obs WHERE priority <> '5-LOW' AND status = 'F' GROUP BY artifact")
add("drop_genes", "SELECT 'G' || p_partkey AS gene_id, p_name AS symbol FROM part WHERE p_partkey NOT IN (SELECT n_nationkey * 3 FROM nation)")
add(
    "join_vocabulary_by_symbol",
    "SELECT artifact, gene_id, min(gene) AS var_idx FROM var JOIN genes USING (gene) JOIN k USING (symbol) GROUP BY artifact, gene_id",
    ", k AS (SELECT symbol, 'G' || lpad(min(gene)::VARCHAR, 8, '0') AS gene_id FROM genes GROUP BY symbol)",
)
add("aligned_share", "SELECT round(100.0 * avg((has = 0)::INT), 6) AS pct_aligned FROM (SELECT artifact, count(*) FILTER (gene = 7) AS has FROM var GROUP BY artifact)")
add("var_inner_join_shared", "SELECT gene FROM (SELECT DISTINCT artifact % 3 AS a, gene FROM owned) GROUP BY gene HAVING count(*) = 3")
add("merged_labels", "SELECT global_idx, coalesce(nullif(segment, 'BUILDING'), 'unknown') AS label FROM numbered")
add("frequent_values", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5")
add("excluding_values", "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE')")
add(
    "class_weights_excluded",
    "SELECT label, n, round(CASE WHEN label = 2 THEN 0 ELSE 50.0::DOUBLE * n / (n + 50.0::DOUBLE) END, 9) AS weight FROM (SELECT (row_number() OVER (ORDER BY priority) - 1)::INT AS label, count(*) AS n FROM obs GROUP BY priority)",
)
add("fill_constants", "SELECT c_custkey, c_nationkey, CASE WHEN n_regionkey <> 2 THEN n_name ELSE 'unknown' END AS name, 'cell' AS suspension_type FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
add("outer_concat", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, NULL AS title FROM nation UNION ALL SELECT r_regionkey, NULL, NULL, r_name FROM region")
add(
    "choose_counts",
    """SELECT artifact, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT artifact, CASE WHEN sum(abs(value - trunc(value))) OVER (PARTITION BY artifact) <> 0 THEN counts ELSE value END AS v FROM x) WHERE v <> 0 GROUP BY artifact""",
    """, x AS (SELECT l_suppkey AS artifact, l_quantity * 2 AS counts, CASE WHEN l_suppkey % 4 = 0 THEN l_quantity + 1 WHEN l_suppkey % 2 = 0 THEN l_discount ELSE l_quantity END AS value FROM lineitem)""",
)
add("length_normalize_assays", "SELECT cell, gene, round(value / CASE WHEN priority < '3' AND p_size % 2 = 0 THEN p_size ELSE 1 END, 6) AS value FROM vals JOIN obs USING (cell) JOIN part ON gene = p_partkey")
add(
    "cluster_renumber",
    """SELECT k.cell_type, k.name, CASE WHEN r = 0 THEN k.cell_type ELSE k.cell_type || '_' || r END AS final FROM k JOIN (
    SELECT cell_type, goal, row_number() OVER (PARTITION BY cell_type ORDER BY sum(n) DESC, goal) - 1 AS r FROM k GROUP BY cell_type, goal) USING (cell_type, goal)""",
    """, k AS (SELECT status AS cell_type, status || '_' || artifact AS name, CASE WHEN artifact % 10 = 1 THEN status || '_0' ELSE status || '_' || artifact END AS goal, count(*) AS n FROM obs GROUP BY ALL)""",
)
add(
    "metacell_cells",
    """SELECT cell, """
    + uniform("'2#' || cell")
    + """ < 0.5 AS is_meta, gene, sum(value) AS value FROM (SELECT * FROM vals UNION ALL
SELECT src + 1, gene, value FROM knn JOIN vals ON cell = dst + 1 WHERE src + 1 IN (SELECT cell FROM vals) AND """
    + uniform("'2#' || (src + 1)")
    + " < 0.5) GROUP BY cell, gene",
)
add("stream_windows", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ALL")
_CELLS = ", dc AS (SELECT obs.* FROM obs JOIN met USING (cell)), dn AS (SELECT *, row_number() OVER (ORDER BY artifact, cell) - 1 AS global_idx FROM dc)"
add(
    "dataset_summary",
    """SELECT count(*) AS n_cells, count(DISTINCT artifact) AS n_artifacts, 1::BIGINT AS n_organisms, (SELECT count(*) FROM genes WHERE organism = 'SMALL') AS n_genes,
       count(DISTINCT priority) + count(DISTINCT segment) AS n_classes, 2 AS n_labels, (SELECT round(sum((artifact + 1) * 1000) / 1e9, 9) FROM (SELECT DISTINCT artifact FROM dc)) AS size_gb FROM dc""",
    _CELLS,
)
add("class_sizes", "SELECT 'priority' AS label, count(DISTINCT priority) AS n_classes FROM dc UNION ALL SELECT 'segment', count(DISTINCT segment) FROM dc", _CELLS)
add("stored_lookup", "SELECT cell, artifact, global_idx, n::INT AS nnz FROM dn JOIN met USING (cell) WHERE global_idx = 23", _CELLS)
add("row_lookup", "SELECT cell, artifact, global_idx, n::INT AS nnz FROM dn JOIN met USING (cell) WHERE global_idx = 17", _CELLS)
add(
    "gene_list",
    "SELECT m.cell, i, f.pos AS gene, coalesce(value, 0) AS x FROM met m JOIN f ON TRUE LEFT JOIN own o ON o.cell = m.cell AND o.pos = f.pos",
    _SMALL + ", f AS (SELECT pos, (row_number() OVER (ORDER BY pos) - 1)::INT AS i FROM sm WHERE organism = 'SMALL' ORDER BY pos LIMIT 5)",
)
_SPLIT = (
    _CELLS
    + """, sz AS (SELECT artifact, count(*) AS n FROM dc GROUP BY artifact),
h AS (SELECT artifact, sum(n) OVER () AS total, sum(n) OVER o <= floor(sum(n) OVER () * 0.15) OR row_number() OVER o = 1 AS held FROM sz WINDOW o AS (ORDER BY md5('42#' || artifact), artifact)),
sp AS (SELECT cell, global_idx, priority, CASE WHEN held THEN 'test' WHEN row_number() OVER (PARTITION BY held ORDER BY md5('42#' || global_idx), global_idx) - 1 < floor(total * 0.2) THEN 'validation' ELSE 'train' END AS split
       FROM dn JOIN h USING (artifact))"""
)
add(
    "loader_splits",
    """SELECT sp.cell, split, code, coalesce(total, 0) AS total FROM sp JOIN (SELECT priority, (row_number() OVER (ORDER BY priority) - 1)::INT AS code FROM (SELECT DISTINCT priority FROM dc)) USING (priority)
LEFT JOIN (SELECT cell, sum(value) AS total FROM own GROUP BY cell) t ON t.cell = sp.cell""",
    _SMALL + _SPLIT,
)
_EPOCH = "SELECT draw_id, global_idx FROM (SELECT draw_id, label, floor(" + uniform("'42e1r#' || draw_id") + " * n)::BIGINT AS pos FROM drawn JOIN cs USING (label)) d JOIN ix USING (label, pos)"
_EPOCH_OF = (
    _SPLIT
    + """, codes AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS label FROM (SELECT DISTINCT priority FROM dc)),
tr AS (SELECT global_idx, label FROM sp JOIN codes USING (priority) WHERE split = 'train'), cs AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
w1 AS (SELECT label, 50.0::DOUBLE * n / (n + 50.0::DOUBLE) AS w FROM cs)"""
    + _CLASSES.format(w="w1")
    + f""", drawn AS (SELECT draw_id, label FROM (SELECT i AS draw_id, {uniform("'42e1#' || i")} AS u FROM range(3000) r(i)) JOIN ivl ON u >= lo AND u < hi),
ix AS (SELECT label, global_idx, row_number() OVER (PARTITION BY label ORDER BY global_idx) - 1 AS pos FROM tr)"""
)
add("loader_epoch", _EPOCH, _EPOCH_OF)
add(
    "stored_epoch",
    "SELECT draw_id, cell, code, round(depth, 6) AS depth FROM (" + _EPOCH + """) JOIN sp USING (global_idx) JOIN (SELECT priority, (row_number() OVER (ORDER BY priority) - 1)::INT AS code FROM (SELECT DISTINCT priority FROM dc)) USING (priority)
JOIN (SELECT cell, total AS depth FROM met) USING (cell)""",
    _EPOCH_OF,
)
