"""Registry guards: oracles present, no row caps or sampling in the SQL."""

import re

from sheaf.plans import registry

ROWS_ONLY: set[str] = set()


def test_every_query_has_an_oracle_but_known_rows_only_ones():
    qs, sqls = registry.queries(), registry.oracle_sql()
    assert set(qs) - set(sqls) == ROWS_ONLY
    assert set(sqls) <= set(qs)


def test_oracle_sql_has_no_row_caps_or_samples():
    for name, sql in registry.oracle_sql().items():
        assert not re.search(r"\bLIMIT\s+\d|\bUSING\s+SAMPLE\b|\bTABLESAMPLE\b", sql, re.I), name
