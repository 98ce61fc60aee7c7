"""Every registered plan against its SQL on the smallest tables, and the driver contract."""

import __spark_entry__ as driver
import oracle
import pytest
from annolytics.plans.all import PLANS
from conftest import SMALL
from pyspark.sql import functions as F

SURVEY_IDS = (
    [f"S{i}" for i in range(1, 12)] + [f"P{i}" for i in range(1, 15)] + [f"T{i}" for i in range(1, 14)]
    + [f"F{i}" for i in range(1, 9)] + [f"L{i}" for i in range(1, 9)] + [f"J{i}" for i in range(1, 12)]
    + [f"D{i}" for i in range(1, 8)] + [f"A{i}" for i in range(1, 26)] + [f"W{i}" for i in range(1, 11)]
    + [f"N{i}" for i in range(1, 11)] + [f"G{i}" for i in range(1, 20)] + [f"I{i}" for i in range(1, 5)]
    + [f"X{i}" for i in range(1, 8)] + [f"K{i}" for i in range(1, 10)] + [f"Y{i}" for i in range(1, 5)]
    + [f"B{i}" for i in range(1, 8)] + ["M1", "M2", "M3", "U1", "U2", "U3", "U4", "Z1", "Z2"]
)


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_plan_equals_sql(spark, duck, name):
    assert oracle.compare(PLANS[name](spark, SMALL), duck, PLANS[name].sql) == []


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if not p.sql])
def test_plan_without_sql_gives_rows(spark, name):
    assert PLANS[name](spark, SMALL).count() > 0


def test_every_inventory_id_is_covered():
    covered = {i for p in PLANS.values() for i in p.covers.split()}
    assert [i for i in SURVEY_IDS if i not in covered] == []


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def with_documents(folder, docs) -> str:
    """The smallest tables, but for their documents."""
    for name in oracle.TABLES:
        if name != "documents":
            (folder / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    docs.toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("titled", [True, False])
def test_variant_items_of_unknown_sources_and_titles_equal_sql(spark, tmp_path, titled):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = F.when(F.col("doc_id") % 5 == 2, None).otherwise(F.col("source"))
    text = F.when(F.col("doc_id").isin(5, 16) | ((F.col("doc_id") == 2) & F.lit(not titled)), None).otherwise(F.col("text"))
    folder = with_documents(tmp_path, docs.withColumns({"source": source, "text": text}))
    plan = PLANS["g17_variant_items"]
    assert oracle.compare(plan(spark, folder), oracle.connect(folder), plan.sql) == []


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Some empty and some null texts, of labelled documents too."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = F.when(F.col("doc_id") % 7 == 3, "").when(F.col("doc_id") % 11 == 5, None).otherwise(F.col("text"))
    return with_documents(tmp_path_factory.mktemp("odd"), docs.withColumn("text", text))


ON_RATINGS = [n for n, p in PLANS.items() if p.sql and "raw_ratings AS" in p.sql]


@pytest.mark.parametrize("name", ON_RATINGS)
def test_plan_on_ratings_of_empty_texts_equals_sql(spark, odd, name):
    assert oracle.compare(PLANS[name](spark, odd), oracle.connect(odd), PLANS[name].sql) == []
