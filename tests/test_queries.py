"""Every core query against its SQL in DuckDB, on the smallest tables; and what the driver relies on."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from vellum import queries as core

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that may find nothing on tables this small.
MAY_BE_EMPTY = {"rule_links", "win1_repeats", "j6_shared_runs", "j5_links_to_other_pages", "j13_unknown_codes", "j7_ambiguous_packages", "j1b_case_mismatch", "j24_substring_anti", "set3_difference", "hlp2_at_most_one", "j20_range_join", "agg4_majority", "agg4_letter_skew", "j25_unknown_numbers", "src9_unzip", "win11_first_hit", "fix6_to_stage"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert got or name in MAY_BE_EMPTY
    if name in core.ORACLE:
        res = duck.execute(core.ORACLE[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == columns
        assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in res.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "href"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_training_data_package():
    """Importing the entry with vellum.llm and corpus_pipeline out of reach leaves the core queries."""
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('vellum.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 150 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_accents_of_every_language(spark, tmp_path):
    """German, unknown and missing languages too, row by row against the standard library."""
    import unicodedata

    rows = [(1, "Müller grüßt", "de"), (2, "straße", "de"), (3, "žluť", "cs"), (4, "naïve", None), (5, "plain", None), (6, "été", "fr"), (7, None, "de"), (None, "ß", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["str3c_without_accents"](spark, str(tmp_path)).collect()
    want = [(i, None if t is None else not any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", t))) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_coverage_of_every_nation(spark, tmp_path):
    """Nation 4 has customers and counts as any other; nation 5 has none."""
    for name, rows, schema in [
        ("nation", [(3, "C"), (4, "D"), (5, "E")], "n_nationkey long, n_name string"),
        ("customer", [(30, 3), (40, 4)], "c_custkey long, c_nationkey long"),
        ("orders", [(40, "1-URGENT", 500000.0), (30, "5-LOW", 500000.0)], "o_custkey long, o_orderpriority string, o_totalprice double"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = entry.queries()["j8_coverage"](spark, str(tmp_path)).collect()
    assert {r["n_nationkey"]: r["status"] for r in got} == {3: "uncovered", 4: "covered", 5: "no-source"}
    assert {r["status"]: r["n"] for r in entry.queries()["agg7_per_status"](spark, str(tmp_path)).collect()} == {"uncovered": 1, "covered": 1, "no-source": 1}
