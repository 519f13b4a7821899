"""Every registered query against its SQL, on the smallest supplied tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from tripledger.checks.compare import difference, open_tables
from tripledger.checks.oracle import oracle_sql
from tripledger.checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="supplied tables not there")


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(driver.queries()) and set(oracle_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_sql(spark, con, key):
    assert difference(spark, con, key, SF_DIR) == ""


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["ano", "mes", "media_valor_total", "total_corridas"] and rows.count() > 60


# --- fixed values: expected counts over the supplied tables at scale 0.001 --------
GOLDEN = {
    "total_registros": 6065, "total_erros": 821, "qtd_vendor_id_nulo": 7, "qtd_pickup_nulo": 8,
    "qtd_dropoff_nulo": 0, "qtd_passenger_nulo": 4, "qtd_amount_nulo": 6, "qtd_vendor_id_invalido": 8,
    "qtd_passenger_invalido": 8, "qtd_dropoff_antes_pickup": 13, "qtd_duracao_excessiva": 4,
    "qtd_duracao_muito_curta": 19, "qtd_pickup_futuro": 307, "qtd_pickup_muito_antigo": 418,
    "percentual_erro": 13.54,
}


def test_golden_counts(spark):
    row = driver.queries()["quality_metrics"](spark, SF_DIR).first().asDict()
    assert {k: row[k] for k in GOLDEN} == GOLDEN
