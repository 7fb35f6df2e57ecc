import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodevec import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return f"{v:.5g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", list(own.ORACLE))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(own.ORACLE[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    got = own.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted("|".join(map(cell, r)) for r in got.select(*names).collect()) == sorted("|".join(map(cell, r)) for r in want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 50


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_text_subpackage(tmp_path):
    """With neither the subpackage nor the pipeline the own queries are all there."""
    root = Path(entry.__file__).parent
    for p in root.rglob("*.py"):
        rel = p.relative_to(root)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] == "tests":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(own.QUERIES)), str(len(own.ORACLE))]


def test_nothing_else_imports_the_text_subpackage():
    root = Path(own.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "lodevec.llm" in p.read_text()]
