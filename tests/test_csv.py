"""Quoted CSV read by splits equals Spark's reader of whole files."""

import csv
import random

import pytest

from modelkeep.sources import tables as S
from modelkeep.sources.csv_records import after, csv_lines

PIECES = ["a", "bc", "1", "", " ", ",", '"', '""', "\n", "\n\n", "é", "x" * 30]


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _folder(tmp_path, files):
    for i, text in enumerate(files):
        (tmp_path / f"f{i}.csv").write_text(text, encoding="utf-8", newline="")
    return str(tmp_path)


def _random_csv(seed, rows, newline="\n"):
    rng = random.Random(seed)
    lines = [["k", "t,1", "u"]] + [[str(i), "".join(rng.choices(PIECES, k=rng.randint(0, 6))), rng.choice(["z", "", "7"])] for i in range(rows)]
    if rows:
        lines[1 + rows // 2][1] = 'long "quoted"\n, value\n' * 40  # crosses many splits
    out = []
    for line in lines:
        out.append(",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r ') else v for v in line))
    return newline.join(out) + (newline if seed % 2 else "")


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_many_splits_equal_the_whole_file_reader(spark, tmp_path, small_splits):
    path = _folder(tmp_path, [_random_csv(1, 200), _random_csv(2, 150), _random_csv(3, 0)])
    assert csv_lines(spark, path).rdd.getNumPartitions() > 40
    whole = S.whole_file_csv(spark, path)
    assert whole.where("`t,1` LIKE '%\n%'").count() > 20
    text = whole.schema
    assert _sorted(S.scan_csv(spark, path, text)) == _sorted(whole)
    typed = S.scan_csv(spark, path)
    assert dict(typed.dtypes) == {"k": "bigint", "t,1": "string", "u": "string"} and typed.count() == 350


def test_every_value_survives(spark, tmp_path, small_splits):
    text = _random_csv(5, 300)
    path = _folder(tmp_path, [text])
    with open(f"{path}/f0.csv", encoding="utf-8", newline="") as f:
        wanted = {r["k"]: r["t,1"] for r in csv.DictReader(f)}
    got = {r[0]: r[1] or "" for r in S.scan_csv(spark, path, "k string, t string, u string").collect()}
    assert got == wanted


@pytest.mark.parametrize("body", [
    "a,b\n1,5\" pipe\n2,x\"y\n3,\"p\"\"q\nr\"\n",          # quotes inside unquoted values are literal
    "a,b\r\n1,x\r\n\r\n2,\"y\nz\"\r\n",                     # CRLF, a blank line
    "\n\na,b\n1\n2,3,4\n,\n",                               # blank lines first, short and long rows
    "a,b\n", "a,b",                                         # no records
    "\"a\",\"b\nc\"\n1,2\n",                                # a header of two lines
])
def test_awkward_files(spark, tmp_path, body):
    path = _folder(tmp_path, [body])
    whole = S.whole_file_csv(spark, path)
    assert _sorted(S.scan_csv(spark, path, whole.schema)) == _sorted(whole)


def test_partition_folders_add_their_column(spark, tmp_path):
    for day in (1, 2):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "f.csv").write_text('k,t\n1,"x\ny"\n')
    got = S.scan_csv(spark, str(tmp_path))
    assert dict(got.dtypes) == {"k": "bigint", "t": "string", "day": "bigint"}
    assert sorted(map(tuple, got.collect())) == [(1, "x\ny", 1), (1, "x\ny", 2)]


def test_an_unclosed_value_runs_to_the_end(spark, tmp_path, small_splits):
    path = _folder(tmp_path, ["a,b\n1,x\n2,\"y\n" + "z,1\n" * 100])
    got = S.scan_csv(spark, path, "a string, b string").collect()
    assert sorted(r["a"] for r in got) == ["1", "2"]
    assert max(len(r["b"]) for r in got) >= 400


@pytest.mark.parametrize("line, start, inside", [
    ("a,b", False, True), ('"', True, False), ('""', False, True), ('"""', True, False), ('a,"b', True, False),
    ('b",c', False, False), ('b","c', True, True), ('b""', False, True), ('5" x', False, False), ('"a"b,"c', True, True)])
def test_a_line_as_a_function_on_states(line, start, inside):
    assert after(line, False) is start
    assert after(line, True) is inside
