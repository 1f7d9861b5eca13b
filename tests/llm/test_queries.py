import pytest

from lonja.llm.queries import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, root, name):
    compare(QUERIES[name](spark, root), SQL[name], root)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    assert df.distinct().count() == df.count() > 0


def test_links_agree_with_the_registry_ids_of_filings(spark, root):
    """Filings without a valid company id mostly carry a registry id, which other filings tie to the company."""
    from pyspark.sql import functions as F

    from lonja.functions.keys import company_id
    from lonja.llm.queries import p6_links
    from lonja.sources import table

    root = root.replace("sf0.001", "sf0.01")
    f = table(spark, root, "principales_cuentas").withColumn("c", company_id(F.col("ruc"))).where("rpj is not null")
    true = f.where("c is not null").groupBy("rpj").agg(F.mode("c").alias("c"))
    known = table(spark, root, "puente_ruc_nemonico").select(company_id(F.col("ruc")).alias("c")).distinct()
    links = {r["nombre"]: r["ruc"] for r in p6_links(spark, root).collect()}
    bridge = {r["c"] for r in known.collect()}
    rows = f.where("c is null").select("rpj", "nombre_empresa").join(true, "rpj").collect()
    right = sum(links.get(r["nombre_empresa"]) == (r["c"] if r["c"] in bridge else None) for r in rows)
    assert right >= 0.95 * len(rows) > 0
