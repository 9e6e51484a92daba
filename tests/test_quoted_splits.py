"""Quoted line breaks found split by split, against the reader that takes each file as a whole."""
import csv
import io
import random

import pytest

from quern.sources import scan as S
from quern.sources.quoted import line_states, quoted_records


def made(seed, rows, newline="\n", delimiter=","):
    draw = random.Random(seed)
    bits = ["plain", "two words", 'say "hi"', f"a{delimiter}b", "line\nbreak", "\n\n", '"', "", "é", "x" * 300, f'"\n{delimiter}"', "1"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n", delimiter=delimiter)
    writer.writerow(["k", "odd, \"name\"" if delimiter == "," else "n", "c"])
    for i in range(rows):
        writer.writerow([i, draw.choice(bits), draw.choice(bits) + draw.choice(bits)][:draw.choice([3, 3, 3, 3, 2])] + ["more"] * (draw.random() < 0.05))
        if draw.random() < 0.05:
            out.write("\n")
        if draw.random() < 0.05:
            out.write(f'{i}{delimiter}5" disk{delimiter}in"side\n')
    return out.getvalue().replace("\n", newline)


def as_rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("name", "delimiter", "newline", "encoding"), [("a.csv", ",", "\n", "utf-8"), ("b.csv", ";", "\r\n", "utf-8"), ("c.tsv", "\t", "\n", "cp1252")])
def test_splits_agree_with_whole_files(spark, small_splits, tmp_path, monkeypatch, name, delimiter, newline, encoding):
    folder = tmp_path / name
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_bytes(made(i, 150, newline, delimiter).encode(encoding))
    df = S.read_delimited(spark, str(folder), delimiter=delimiter, encoding=encoding)
    assert quoted_records(spark, str(folder), delimiter, S.READ_AS.get(encoding, encoding)).rdd.getNumPartitions() > 12
    rows = as_rows(df)
    monkeypatch.setattr(S, "quoted_records", None)
    shape = S.text_shape(spark, str(folder))
    shape.lines += 1   # as if there were lone carriage returns
    whole = S.read_delimited(spark, str(folder), delimiter=delimiter, encoding=encoding, shape=shape)
    assert len(rows) > 400 and df.dtypes == whole.dtypes and rows == as_rows(whole)


def test_a_record_over_many_splits_and_one_that_never_ends(spark, small_splits, tmp_path):
    long_ = "\n".join(f"line {i}" for i in range(3000))
    path = tmp_path / "long.csv"
    path.write_text(f'a,b\n1,"{long_}"\n2,x\n3,"{long_}\n"\n4,y\n')
    assert as_rows(S.read_delimited(spark, str(path))) == sorted([("1", long_), ("2", "x"), ("3", long_ + "\n"), ("4", "y")])
    (tmp_path / "open.csv").write_text("a,b\n" + "1,x\n" * 900 + '2,"' + "never closed\n" * 900)
    rows = S.read_delimited(spark, str(tmp_path / "open.csv"), infer_types=False).collect()
    assert len(rows) == 901 and sum(r.a == "2" for r in rows) == 1


@pytest.mark.parametrize(("line", "inside", "want"), [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"', False, False), ('5" disk,x', False, False), ('"', True, False), ("x", True, True),
    ('x",y', True, False), ('x","y', True, True), ('x""', True, True), ('"a"b"c,"d', False, True), ("", True, True), ("", False, False), ('",', True, False), ('","', True, True)])
def test_line_states(line, inside, want):
    assert line_states(",")(line, inside) is want
