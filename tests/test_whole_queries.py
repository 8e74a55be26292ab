"""Queries of whole tables against a count of what there is."""

import os

import duckdb
import numpy as np

from cellspark.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_neighbours_of_all_cells_are_filled(spark):
    got = QUERIES["collate_neighbours_filled"](spark, SF).collect()
    few = {r.cell for r in QUERIES["collate_neighbours"](spark, SF).collect()}
    n = {c: len({r.gene for r in got if r.cell == c}) for c in {r.cell for r in got}}
    assert set(n.values()) == {2} and few < set(n)


def test_whole_vocabularies_are_joined(spark):
    n_genes, n_small, pairs = duckdb.sql(f"""SELECT (SELECT count(*) FROM '{SF}/part.parquet'), (SELECT count(*) FROM '{SF}/part.parquet' WHERE p_type = 'SMALL'),
        (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, l_partkey FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey
         JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey))""").fetchall()[0]
    got = QUERIES["join_vocabulary_whole"](spark, SF).collect()
    assert len(got) == pairs and len({r.gene_id for r in got}) == n_genes
    assert {r.pos for r in QUERIES["zero_fill_genes_organism"](spark, SF).collect()} == set(range(n_small))


def test_cells_with_one_known_gene_have_it(spark):
    """Cells for which they and their neighbours have but one known gene were left out."""
    table = lambda name: duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()
    at, line, part = table("embeddings"), table("lineitem"), table("part")
    known = set(part[part["p_type"] == "SMALL"]["p_partkey"])
    genes = {c: set(g) & known for c, g in line.groupby("l_orderkey")["l_partkey"]}
    held = {}
    for _, own in at.groupby("label"):
        x, ids = np.stack(own["embedding"].to_numpy()).astype(float), own["vec_id"].to_numpy()
        for i, row in enumerate(x):
            far = np.where(ids == ids[i], np.inf, np.sqrt(((x - row) ** 2).sum(1)))
            near = ids[np.lexsort((ids, far))[:6]]
            held[int(ids[i]) + 1] = set().union(*(genes.get(int(c) + 1, set()) for c in (ids[i], *near)))
    got = QUERIES["collate_neighbours"](spark, SF).groupBy("cell").count().collect()
    want = {c: min(2, len(g)) for c, g in held.items() if g}
    assert {r.cell: r["count"] for r in got} == want and 1 in want.values()
