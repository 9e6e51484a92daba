"""Jobs parse their input once, and leave nothing behind."""
import os

import pytest

from quern.plans import jobs
from quern.sources import scan as S
from quern.sources.staging import Staging


def files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


@pytest.fixture
def shared(tmp_path, monkeypatch):
    folder = str(tmp_path / "shared")
    monkeypatch.setattr("quern.sources.staging._folder", lambda spark: folder)
    return folder


@pytest.mark.parametrize(("name", "content"), [
    ("t.csv", "id;Flag;a b\n" + "".join(f"{i};{' yes' if i % 2 else 'No'};{i}.5\n" for i in range(60))),
    ("t.csv", 'id;Flag;a b\n' + "".join(f'{i};{"yes" if i % 2 else "No"};"x\n{i % 3}"\n' for i in range(60))),
    ("t.json", "\n".join(f'{{"id": {i}, "Flag": "{"yes " if i % 2 else "No"}", "n": {{"a b": {i}}}}}' for i in range(60)))])
def test_the_source_is_not_needed_after_the_scan(spark, shared, tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    plain = jobs.analyze(S.scan(spark, str(path))[0])
    want = sorted(map(str, plain.table.collect()))
    with Staging(spark) as stage:
        df, meta = S.scan(spark, str(path), stage)
        os.remove(path)
        found = jobs.analyze(df, stage=stage)
        assert meta.rows == 60 and sorted(map(str, found.table.collect())) == want
        assert found.facts.columns.keys() == plain.facts.columns.keys() and found.table.dtypes == plain.table.dtypes
        assert files(stage.folder)
    assert not os.path.exists(stage.folder)


def test_jobs_release_their_staging(spark, shared, tmp_path, capsys):
    path = tmp_path / "t.csv"
    path.write_text("id,v\n" + "".join(f"{i},{i % 7}\n" for i in range(50)))
    assert jobs.main(["clean", str(path), "-o", str(tmp_path / "out.parquet")], spark) == 0
    assert "written" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out.parquet")).count() == 7
    assert not [f for f in files(shared) if "staging-" in f]


def test_tables_as_they_lie_are_not_kept_whole_for_their_profile(spark, monkeypatch):
    from quern.plans import queries as Q
    kept = {}
    monkeypatch.setattr(Q.P, "profile", lambda df, persist=False: kept.setdefault(df.columns[0], persist))
    for name in ("lineitem", "orders_dirty"):
        Q.facts(spark, "/root/testdata/sf0.001", name)
    Q._memo.clear()
    assert kept == {"l_orderkey": False, "order_id": True}
