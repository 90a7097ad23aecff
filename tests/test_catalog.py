"""Every query runs, and has the rows that its SQL gives in DuckDB."""

import os

import pytest

from cairnspark.plans import catalog_disk as catalog
from cairnspark.sources import corpus, files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _rows(table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(repr(tuple(r[n] for n in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toArrow()
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert _rows(got) == _rows(want)


def test_neutral_groups_have_both_halves(spark, sf_dir):
    got = catalog.QUERIES["neutral_groups"](spark, sf_dir).toArrow()
    assert sorted(got.column("mode").to_pylist()) == ["exact", "perceptual"]


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(b"123")
    (tmp_path / "m.tsv").write_text("path\tbytes\thash\n/a\t5\tff\n")
    (tmp_path / "s.log").write_text("# t main\n1 2.5 3 4 5 6\n")
    (tmp_path / "p.json").write_text('{"image": {"quality": 200}}')
    [r] = files.scan_files(spark, [f"file://{tmp_path}/a"]).collect()
    assert (r.path, r.name, r.size) == (f"{tmp_path}/a/x.jpg", "x.jpg", 3)
    assert files.scan_files(spark, [f"file://{tmp_path}/a"], True).first().content == b"123"
    assert files.root_access(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/none"]) == [(f"file://{tmp_path}/a", "ok"), (f"file://{tmp_path}/none", "missing")]
    assert tuple(files.read_manifest(spark, f"file://{tmp_path}/m.tsv").first()) == ("/a", 5, "ff")
    assert files.read_sample_log(spark, f"file://{tmp_path}/s.log").first().main_mb == 2.5
    profile, fixes = files.load_settings(spark, f"file://{tmp_path}/p.json")
    assert profile.image.quality == 100 and len(fixes) == 1
    assert files.load_settings(spark, f"file://{tmp_path}/none.json")[1] == []
    files.save_settings(spark, f"file://{tmp_path}/p.json", profile)
    assert files.load_settings(spark, f"file://{tmp_path}/p.json") == (profile, []) and not list(tmp_path.glob("*.tmp"))


def test_generated_inputs(spark):
    rows = {r.kind: r["count"] for r in corpus.inventory(spark, 1000).groupBy("kind").count().collect()}
    assert rows == {"image": 920, "video": 50, "audio": 20, "other": 10}
    a, b = (corpus.random_prints(spark, 50).collect() for _ in range(2))
    assert a == b and len({r.fp0 for r in a}) == 50
