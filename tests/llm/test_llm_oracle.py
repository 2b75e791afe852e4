"""The registered queries over the whole small tables; those with SQL against it."""

import pytest

import oracle
from lexweave.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE:
        assert oracle.compare(df, oracle.connect(SF), catalogue.ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_found_columns(spark):
    want = {"p2_found": ["table_name", "precedent_id", "paragraph_id"], "p3_found": ["table_name", "record_id", "paragraph_id"], "p5_found": ["id_a", "id_b"], "p8_found": ["doc_id"]}
    for name, cols in want.items():
        df = catalogue.QUERIES[name](spark, SF)
        assert df.columns == cols
        assert df.count() == df.distinct().count()
