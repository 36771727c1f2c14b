"""CSV files read by many tasks: records whose quoted cells hold line breaks, at every block size."""

import csv
import random

import pytest

from tessera.sources import store


def plain(paths):
    """Rows by Python's reader, in which line breaks in cells are those of the file."""
    out = []
    for p in paths:
        with open(p, newline="") as f:
            rows = [r for r in csv.reader(f) if r]
        out += [dict(zip(rows[0], (c.replace("\r\n", "\n") for c in r), strict=True)) for r in rows[1:]]
    return out


def write(path, header, rows, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows([header, *rows])


def cells(seed, n):
    rnd = random.Random(seed)
    kinds = [lambda: "", lambda: "plain", lambda: 'say "hi"', lambda: "two\nlines", lambda: "\n\n", lambda: "a,b", lambda: " spaced ", lambda: '"',
             lambda: "é" * rnd.randint(1, 40), lambda: '""\n"' * rnd.randint(1, 5), lambda: "long\n" * rnd.randint(1, 400)]
    return [[str(i), rnd.choice(kinds)(), rnd.choice(kinds)()] for i in range(n)]


def as_set(rows):
    return sorted(tuple(sorted(r.items())) for r in rows)


@pytest.fixture
def blocks_of(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, end", [(97, "\n"), (1000, "\r\n"), (1 << 20, "\n")])
def test_one_large_file_in_many_tasks(spark, tmp_path, blocks_of, size, end):
    path = str(tmp_path / "t.csv")
    write(path, ["id", "a", "b"], cells(size, 150), end)
    blocks_of(size)
    got = store.read_csv_table(spark, path)
    assert as_set(r.asDict() for r in got.drop("_corrupt_record").collect()) == as_set(plain([path]))
    assert got.where("_corrupt_record is not null").count() == 0
    if size < 1 << 20:
        assert got.rdd.getNumPartitions() > 4


def test_sorted_instead_of_broadcast(spark, tmp_path, blocks_of, monkeypatch):
    from tessera.sources import csv_records
    monkeypatch.setattr(csv_records, "BROADCAST_BLOCKS", 0)
    path = str(tmp_path / "t.csv")
    write(path, ["id", "a", "b"], cells(5, 120))
    blocks_of(200)
    assert as_set(r.asDict() for r in store.read_csv_table(spark, path).drop("_corrupt_record").collect()) == as_set(plain([path]))


def test_files_of_different_headers(spark, tmp_path, blocks_of):
    blocks_of(300)
    write(tmp_path / "a.csv", ["id", "x", "y\nz"], cells(1, 40))
    write(tmp_path / "b.csv", ["y\nz", "id", "x"], [[c, a, b] for a, b, c in cells(2, 40)])
    write(tmp_path / "c.csv", ["id", "x"], [r[:2] for r in cells(3, 40)])
    write(tmp_path / "d.csv", ["id", "x"], [])
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("\n\nid,x\n\n7,seven\n\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    want = [{"y\nz": ""} | r for r in plain(paths)] + [{"id": "7", "x": "seven", "y\nz": ""}]
    assert as_set(r.asDict() for r in store.read_csv_table(spark, str(tmp_path)).drop("_corrupt_record").collect()) == as_set(want)


def test_ragged_rows_and_an_open_quote(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,a\n1,x\n2\n3,x,y\n4,"open\nto the end\n')
    got = {r.id: r._corrupt_record for r in store.read_csv_table(spark, str(tmp_path)).collect()}
    assert got["1"] is None and got["2"] and got["3"] and set(got) == {"1", "2", "3", "4"}


def test_no_file_is_an_error(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(LookupError):
        store.read_csv_table(spark, str(tmp_path))
