"""Every query that has SQL gives the SQL's rows."""

import os
from decimal import Decimal

import duckdb
import pytest

from larkspan.plans import catalog


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        out.append(tuple("" if r[i] is None else f"{float(r[i]):.6g}" if isinstance(r[i], (float, Decimal)) else str(r[i]) for i in order))
    return sorted(columns), sorted(out)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = duck.execute(catalog.ORACLES[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in expected.description], expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).head(1)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_optional_module_itself_may_be_absent(tmp_path, monkeypatch):
    import __spark_entry__

    (tmp_path / "broken_module.py").write_text("import a_module_that_nobody_has\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert __spark_entry__._optional("another_module_that_nobody_has") is None
    with pytest.raises(ModuleNotFoundError, match="a_module_that_nobody_has"):
        __spark_entry__._optional("broken_module")
