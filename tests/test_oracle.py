"""Every core query against its SQL, over the whole small tables; queries without SQL must give rows."""

import pytest

import oracle
from lexweave.plans import catalogue

SF = "/root/testdata/sf0.001"
EMPTY = {"domain_violations", "customers_without_orders", "batch_search", "canonical_duplicates"}  # may have no rows on small tables


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE:
        assert oracle.compare(df, con, catalogue.ORACLE[name]) in ({"", "no rows"} if name in EMPTY else {""})
    else:
        assert df.count() >= (name not in EMPTY)
