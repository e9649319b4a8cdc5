import csv as plain
import io
import random

import pytest

from peerscreen.sources import csv, records

HEAD = "component_id,batch_id,component_family,hours,measurement_name,measurement_value,upper_limit"
REQUIRED = ["a", "b"]


@pytest.fixture
def cut(spark):
    """Splits of a few dozen bytes, so that records cross several of them."""

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def rows_of(df):
    return sorted(
        (r.path.rsplit("/", 1)[-1], r.line or 0, r.code or "", r.column_name or "", sorted((r.cells or {}).items())) for r in df.collect()
    )


def expected(files, required, max_rows=10**9):
    out = []
    for name, data in files.items():
        for line, cells, code, column in csv.parse_file(data if isinstance(data, bytes) else data.encode(), required, max_rows):
            out.append((name, line or 0, code or "", column or "", sorted((cells or {}).items())))
    return sorted(out)


def test_ends_of_lines():
    for line, inside, end in [
        ('a,b', False, False), ('a,"b', False, True), ('a"b,c', False, False), ('"a""', False, True), ('"a"",b', False, True),
        ('a",b', True, False), ('a"",b', True, True), ('a","b', True, True), ('', True, True), ('"', False, True), ('""', False, False),
        ('x\r"a', False, True), ('x",y\r"z"', True, False),
    ]:
        assert records.ends_inside(line, inside)[0] == end, (line, inside)


def random_file(rng):
    """Cells with quotes, commas and line breaks of all kinds, some lines blank, line ends mixed."""
    out, ends = io.StringIO(newline=""), rng.choice(["\n", "\r\n"])
    out.write(rng.choice(["", "\n", " , \n"]) + "a,b, c " + ends)
    for _ in range(rng.randrange(1, 25)):
        cells = []
        for _ in range(rng.randrange(1, 4)):
            text = "".join(rng.choice(["x", "µ", '"', ",", "\n", "\r\n", "\r", " ", "yy"]) for _ in range(rng.choice([0, 2, 5, 60])))
            cells.append('"' + text.replace('"', '""') + '"' if rng.random() < 0.8 or set(text) & set(',"\r\n') else text)
        out.write(",".join(cells) + rng.choice([ends, ends, ends, ends + ends]))
    return out.getvalue()


@pytest.mark.parametrize("size", [90, 400])
def test_equal_to_a_plain_reader(spark, tmp_path, cut, size):
    rng = random.Random(size)
    files = {f"f{i}.csv": random_file(rng) for i in range(4)}
    files["windows.csv"] = random_file(rng).encode("cp1252")
    files["loose.csv"] = 'a,b\n5" disk,2\n"p\nq",5"\n'
    files["junk.csv"] = 'a,b\n' + '"k\nl",m\n' * 20 + '"x"y,2\n' + '"k\nl",m\n' * 20
    files["open.csv"] = 'a,b\n' + '1,2\n' * 30 + '"3,4\n' + "5,6\n" * 30
    cut(size)
    path = write(tmp_path / "r", files)
    assert records._lines(spark, path, "*.csv").rdd.getNumPartitions() > 12
    assert rows_of(records.read_records(spark, path, required=REQUIRED)) == expected(files, REQUIRED)


def test_refusals_and_notes(spark, tmp_path, cut):
    files = {
        "double.csv": "a,b,a\n1,2,3\n",
        "missing.csv": "a,c\n1,2\n",
        "blank_names.csv": "a,b,,\n1,2,3,4\n",
        "head_only.csv": "a,b\n",
        "nothing.csv": "\n\n,\n",
        "wide.csv": "a,b\n1,2\n1,2,3\n",
        "short.csv": 'a,b\n1\n\n"",\n',
        "undecodable.csv": b"a,b\n\x81,2\n",
        "many.csv": "a,b\n" + "1,2\n" * 5,
        "bom.csv": "a,b\n1,2\n".encode("utf-8-sig"),
        "header_of_two_lines.csv": 'a,b,"c\nd"\n1,2,3\n',
        "long.csv": 'a,b\n1,"' + ("z" * 70 + "\n") * 1_900 + '"\n',
    }
    cut(2_000)
    got = records.read_records(spark, write(tmp_path / "n", files), required=REQUIRED, max_rows=4)
    assert rows_of(got) == expected(files, REQUIRED, 4)


def test_both_ways_of_meeting_give_the_same(spark, tmp_path, cut, monkeypatch):
    files = {"q.csv": "a,b\n" + "".join(f'"{i}\n{i}",{i}\n' for i in range(60)), "p.csv": "a,b\n1,2\n"}
    cut(90)
    path = write(tmp_path / "w", files)
    monkeypatch.setattr(records, "BROADCAST_BYTES", 0)
    assert rows_of(records.read_records(spark, path, required=REQUIRED)) == expected(files, REQUIRED)


def test_no_files_of_use(spark, tmp_path):
    assert records.read_records(spark, write(tmp_path / "e", {"e.csv": ""}), required=REQUIRED).isEmpty()


def test_bulk_intake(spark, tmp_path, cut):
    body = "".join(f'c{i},b,f,{h},"m\n""{h % 2}""",1.5,2\n' for i in range(100) for h in (0, 24))
    files = {"a.csv": HEAD + "\n" + body, "b.csv": HEAD + "\nd,b,f,0,m,oops,2\n"}
    cut(700)
    got = csv.ingest_bulk(spark, write(tmp_path / "b", files))
    assert [(r.path.rsplit("/", 1)[-1], r.line, r.column_name, r.code) for r in got.errors.collect()] == [("b.csv", 2, "measurement_value", "NON_FINITE_VALUE")]
    want = {(i + 0, f'm\n"{h % 2}"') for i in range(100) for h in (0, 24)}
    assert {(int(r.component_id[1:]), r.measurement_name) for r in got.clean.collect()} == want and got.clean.count() == 200
    assert len(list(plain.reader(io.StringIO(files["a.csv"], newline="")))) == 201
