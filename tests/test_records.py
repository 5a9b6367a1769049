"""Records with quoted line breaks against Python's csv module, with splits cut anywhere."""

from __future__ import annotations

import csv
import gzip
import io
import random

import pytest
from pyspark.sql import types as T

from recon.sources import loaders, records

TYPE = T.StructType().add("a", "string").add("b", "string").add("c", "string")


def some_csv(seed: int, rows: int) -> tuple[str, list[list[str]]]:
    pick = random.Random(seed)
    cells = ["x", "", "two words", "line\nbreak", 'a "quoted" word', "comma, here", "\n\n", '"', 'ends with "', "\r\nwindows", "plain" * 9, 'é,"ü"\n']
    out = io.StringIO()
    for _ in range(rows):
        row = [pick.choice(cells) for _ in range(3)]
        row[0] = row[0] or "k"
        csv.writer(out, lineterminator=pick.choice(["\n", "\r\n"])).writerow(row)
        if pick.random() < 0.1:
            out.write("\n")
    return out.getvalue(), [r for r in csv.reader(io.StringIO(out.getvalue(), newline="")) if any(x.strip() for x in r)]


@pytest.mark.parametrize("split_bytes", (64, 300, 1 << 20))
def test_records_by_hand(spark, tmp_path, split_bytes):
    want = []
    for i in range(3):
        text, rows = some_csv(i, 150)
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
        want += rows
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [next(csv.reader(io.StringIO(r.record, newline=""))) for r in records.records(spark, str(tmp_path)).collect()]
        states = records.split_states(spark, str(tmp_path))
        if split_bytes < 1000:
            assert states.count() > 9 and states.where("inside").count() > 3
        loaded = loaders.load_csv_checked(spark, str(tmp_path), TYPE)
        parsed = [[x or "" for x in r] for r in loaded.rows.collect()]
        assert loaded.dropped.isEmpty()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sorted(got) == sorted(want)
    loose = lambda rows: sorted([x.replace("\r\n", "\n") for x in r] for r in rows)
    assert loose(parsed) == loose(want)


def test_compressed_and_unclosed(spark, tmp_path):
    with gzip.open(tmp_path / "one.csv.gz", "wt", newline="") as out:
        out.write('1,"a\nb",c\n2,d,e\n')
    (tmp_path / "two.csv").write_text('3,x,y\n4,"never\nclosed,\n5,z\n')
    got = sorted(r.record for r in records.records(spark, str(tmp_path)).collect())
    assert got == ['1,"a\nb",c', "2,d,e", "3,x,y", '4,"never\nclosed,\n5,z']


def test_stray_quotes_and_blank_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,in"ch,2\n3,"closed"tail,4\n')
    (tmp_path / "b.csv").write_text("\n \n")
    assert sorted(r.record for r in records.records(spark, str(tmp_path)).collect()) == ['1,in"ch,2', '3,"closed"tail,4']


def test_a_record_without_end_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"' + "x\n" * 5000)
    with pytest.raises(Exception, match="more than 1000 bytes"):
        records.records(spark, str(tmp_path), most_bytes=1000).collect()
