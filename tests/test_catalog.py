import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest

from gridwright.plans.catalog_more import ORACLE_SQL, QUERIES

from oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = connect(SF).sql(ORACLE_SQL[name]).df()
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
