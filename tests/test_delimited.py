"""Quoted CSV in splits of any size against Python's reader."""

import csv
import io
import random

import pytest

from chronoview.sources import delimited

CELLS = ["", "a", "two words", 'say "x"', '"', '""', "a,b", "line\nbreak", "\n", "\n\n,\n", 'q"\n"q', "é x", " lead", "\\", "end\\", "x" * 300, '5" pipe']


def wanted(text):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return sorted(tuple(c for c in r) for r in rows[1:] if r)


def shown(df):
    """An empty unquoted cell is null, which Python's reader does not tell apart from an empty quoted one."""
    return sorted(tuple(c if c is not None else "" for c in r) for r in df.collect())


@pytest.fixture
def splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield to
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 97), (3, 1000), (4, 1 << 20)])
def test_same_rows_whatever_the_splits(spark, splits, tmp_path, seed, size):
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator="\n")
    writer.writerow(["id", "note", "x y"])
    for i in range(200):
        writer.writerow([i, rng.choice(CELLS) + rng.choice(CELLS), rng.choice(CELLS)])
    path = tmp_path / "t.csv"
    path.write_text(out.getvalue(), newline="")
    splits(size)
    df = delimited.read_csv(spark, str(path))
    assert df.columns == ["id", "note", "x y"] and shown(df) == wanted(out.getvalue())
    lines = delimited._lines(spark, str(path))
    assert size > 1000 or lines.rdd.getNumPartitions() >= len(out.getvalue()) // (2 * size)


def test_same_rows_as_one_task_a_file(spark, splits, tmp_path):
    """The plain reader with multiLine, over a folder of files with odd ends."""
    texts = ['a,b\n1,"x\ny"\n2,\n\n3,""\n', 'a,b\r\n4,"p\r\nq"\r\n5,z', "a,b\n", 'a,b\n6\n7,8,9\n"un""quoted",5" pipe\n']
    for i, t in enumerate(texts):
        (tmp_path / f"p{i}.csv").write_text(t, newline="")
    splits(7)
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    plain = spark.read.options(**options).csv(str(tmp_path))
    key = lambda r: tuple("" if c is None else "=" + c for c in r)
    assert sorted(map(key, delimited.read_csv(spark, str(tmp_path)).collect())) == sorted(map(key, plain.collect()))


def test_state_of_lines():
    for line, inside, after in [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('"a""', False, True), ('""', True, True), ('5" x,"y"', False, False), ("", True, True), ('x"",y"', True, False), ('"a"b",c', False, False)]:
        assert delimited.ends_inside(line, inside) == after, line
