"""CSV files cut into byte ranges: the automaton, the cuts, the scan."""

import csv
import gzip
import os
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biaslens.sources import csv_ranges as cr
from biaslens.sources import io

ALPHABET = ['"', ",", "\n", "a", "é", '""', "\r\n"]


def stepped(piece: bytes, state: int) -> int:
    for b in piece:
        state = cr.STEPS[cr.CLASSES.get(b, "other")][state]
    return state


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map(lambda x: "".join(x).encode()), st.integers(0, 40))
def test_functions_compose(piece, cut):
    f = cr.FUNCTIONS[cr.transition(piece)]
    assert [f[s] for s in range(5)] == [stepped(piece, s) for s in range(5)]
    a, b = cr.transition(piece[:cut]), cr.transition(piece[cut:])
    assert cr.FUNCTIONS[cr.COMPOSED[a, b]] == f


def rows_of(path, size):
    """All records, through ranges of ``size`` bytes."""
    reader = cr.StateReader(str(path), size)
    table = cr.pa.Table.from_pylist([dict(zip(("file", "start", "end", "step", "header"), r))
                                     for p in reader.partitions() for r in reader.read(p)])
    fs = cr.pafs.LocalFileSystem()
    out, at = [], []
    for r in cr._resolve(table).to_pylist():
        for place, cells in cr.Range(r["file"], r["start"], r["end"], r["state"]).records(fs):
            out.append(cells)
            at.append(place)
    assert at == sorted(set(at))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text('a",\né "', max_size=9), st.text('b"\n,', max_size=5)), min_size=1, max_size=12),
       st.integers(1, 60))
def test_any_cut_gives_the_same_records(tmp_path_factory, rows, size):
    path = tmp_path_factory.mktemp("c") / "x.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
        writer.writerows([("x", "y"), *rows])
    assert rows_of(path, size) == [["x", "y"], *map(list, rows)]


def test_quotes_inside_plain_cells_open_nothing(tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n1"2,x"\n"q"r,"s\nt"\n\n5\' 6",7\n')
    want = [["a", "b"], ['1"2', 'x"'], ["qr", "s\nt"], ["5' 6\"", "7"]]
    for size in (1, 2, 3, 5, 8, 13, 1000):
        assert rows_of(path, size) == want


def spark_scan(spark, path):
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return raw


def sample(path, n=400):
    rng = random.Random(5)
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(["id", "comment_text", "target"])
        for i in range(n):
            writer.writerow([i, "".join(rng.choices(['"', "\n", ",", "word ", "é", "日"], k=rng.randint(1, 60))) + "x", i / 7])


def test_one_file_gives_many_partitions_equal_to_the_plain_scan(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    sample(path)
    cells, header = cr.scan(spark, path, ["target", "id", "comment_text"], range_bytes=1000)
    assert header == ["id", "comment_text", "target"]
    assert cells.rdd.getNumPartitions() >= 20
    plain = spark_scan(spark, path).select("target", "id", "comment_text")
    assert plain.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, plain.collect()))


def test_folders_headers_of_their_own_and_compressed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,comment_text\n1,\"x\ny\"\n2,z", encoding="utf-8")
    (tmp_path / "_skip.csv").write_text("no")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "only_header.csv").write_text("comment_text,id\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("comment_text,n,id\r\n\"q\"\"r\",5,3\r\n")
    sch = io.comment_schema(("id", "comment_text"))
    got = io.read_comments_csv(spark, str(tmp_path), sch, range_bytes=4).collect()
    assert sorted(map(tuple, got)) == [(1, "x\ny"), (2, "z"), (3, 'q"r')]


def test_faults_name_their_place(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,comment_text\n1,a\n2\n3,b,c\n")
    sch = io.comment_schema(("id", "comment_text"))
    with pytest.raises(Exception, match="cells"):
        io.read_comments_csv(spark, str(path), sch).collect()
    got = io.read_comments_csv(spark, str(path), sch, strict=False).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a"), (2, None), (3, "b")]
    with pytest.raises(Exception, match="(?i)not ?found|no such"):
        io.read_comments_csv(spark, str(tmp_path / "none.csv"), sch)


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from biaslens.session import build_session
from biaslens.sources import io
from biaslens.plans import irls
spark = build_session("local[2]", shuffle_partitions=2)
assert io.read_comments_csv(spark, {path!r}, io.comment_schema(("id", "comment_text", "target")), range_bytes=900).count() == 50
rows = spark.range(200).select(F.array((F.col("id") % 7).cast("double")).alias("features"), (F.col("id") % 3 == 0).cast("double").alias("y"))
assert irls.fit(rows, [irls.Model("m", "y")], 1)["m"].n_rows == 200
print("works")
"""


def test_scans_and_fits_from_another_working_directory(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sample(str(tmp_path / "x.csv"), 50)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"BIASLENS_SCRATCH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=root, path=str(tmp_path / "x.csv"))], cwd=tmp_path,
                          env=env, capture_output=True, text=True, timeout=300)
    assert "works" in done.stdout, done.stderr[-3000:]
