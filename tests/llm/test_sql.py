import sys
from pathlib import Path

import pytest

from auditlake.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(name, spark, sf_dir):
    from oracle import compare, connect

    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None
