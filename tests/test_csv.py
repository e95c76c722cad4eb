import pytest
from helpers import rows
from pyspark.sql import types as T

from rollbook.sources import csv

COLUMNS = T.StructType(
    [
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("n", T.IntegerType()),
    ]
)


READS = ["whole", "split", "assembled"]


@pytest.fixture(params=READS)
def reading(request, monkeypatch):
    """Each way a file may be read."""
    if request.param != "whole":
        monkeypatch.setattr(csv, "ONE_TASK_BYTES", 0)
    return {"whole": None, "split": False, "assembled": True}[request.param]


def write(tmp_path, text, name="f.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


@pytest.mark.parametrize("bound", [0, csv.ONE_TASK_BYTES])
def test_positional_ignores_header_names(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(csv, "ONE_TASK_BYTES", bound)
    path = write(tmp_path, '﻿x,"y, z",w\r\n1,"",7\r\n,"q ""r"", s\nt",\r\n u ,v,-1\r\n')
    loaded = csv.load_positional(spark, path, COLUMNS)
    assert rows(loaded) == [(" u ", "v", -1), ("1", "", 7), (None, 'q "r", s\nt', None)]


@pytest.mark.parametrize("line", ["1,2", "1,2,3,4", "1,2,x"])
def test_positional_fails_whole(spark, tmp_path, line, reading):
    path = write(tmp_path, f"a,b,n\nok,ok,1\n{line}\n")
    loaded = csv.load_positional(spark, path, COLUMNS, spanning=reading)
    with pytest.raises(Exception, match="MALFORMED"):
        loaded.collect()
    if not line.endswith("x"):
        with pytest.raises(Exception, match="MALFORMED"):
            loaded.select("a").collect()


def test_positional_source_order(spark, tmp_path, reading):
    write(tmp_path, "a,b,n\nz,z,1\ny,y,2\n", "1.csv")
    write(tmp_path, "a,b,n\nb,b,3\na,a,4\n" + "c,c,5\n" * 50, "2.csv")
    loaded = csv.load_positional(spark, str(tmp_path), COLUMNS, spanning=reading, source_order="o")
    assert [r["n"] for r in loaded.orderBy("o").collect()] == [1, 2, 3, 4] + [5] * 50


@pytest.mark.parametrize(
    ("line", "sep"), [("a;b", ";"), ("a\tb", "\t"), ("a,b", ","), ('"x;y",b', ";"), ("a", ",")]
)
def test_sniff(spark, tmp_path, line, sep):
    assert csv.sniff_delimiter(spark, write(tmp_path, line + "\n1\t2;3,4\n")) == sep


ALLOWED = ["nama", "kabupaten", "peran"]


@pytest.mark.parametrize("sep", [";", "\t", ","])
def test_by_name(spark, tmp_path, sep, reading):
    text = f'﻿"PERAN"{sep} Nama \r\n"x"{sep}\r\n""{sep}"A{sep} B"\r\n'
    loaded = csv.load_by_name(spark, write(tmp_path, text), ALLOWED, spanning=reading)
    assert loaded.columns == ALLOWED
    assert rows(loaded) == [("A" + sep + " B", None, ""), (None, None, "x")]


def test_by_name_unknown_columns(spark, tmp_path):
    path = write(tmp_path, "nama,umur,peran\na,1,b\n")
    with pytest.raises(ValueError, match="unknown columns"):
        csv.load_by_name(spark, path, ALLOWED)
    loaded = csv.load_by_name(spark, path, ALLOWED, on_unknown="drop", source_order="o")
    assert rows(loaded, *ALLOWED) == [("a", None, "b")]
    with pytest.raises(ValueError, match="on_unknown"):
        csv.load_by_name(spark, path, ALLOWED, on_unknown="keep")


@pytest.mark.parametrize(("header", "message"), [("x,y", "no allowed"), ("nama,NAMA", "repeated")])
def test_by_name_bad_header(spark, tmp_path, header, message):
    with pytest.raises(ValueError, match=message):
        csv.load_by_name(spark, write(tmp_path, header + "\n1,2\n"), ALLOWED)


def test_by_name_headers_must_agree(spark, tmp_path, reading):
    write(tmp_path, "nama,peran\na,b\n", "1.csv")
    write(tmp_path, "peran,nama\nb,a\n", "2.csv")
    with pytest.raises(Exception, match="header"):
        csv.load_by_name(spark, str(tmp_path), ALLOWED, spanning=reading).collect()


def test_by_name_short_row_fails(spark, tmp_path):
    path = write(tmp_path, "nama,peran\na\n")
    with pytest.raises(Exception, match="MALFORMED"):
        csv.load_by_name(spark, path, ALLOWED).collect()


@pytest.mark.parametrize("spanning", [None, True])
def test_records_over_many_blocks(spark, conf, tmp_path, monkeypatch, spanning):
    """Records that span lines, and blocks, of files that many tasks read."""
    conf(files__maxPartitionBytes=2000, files__openCostInBytes=1)
    monkeypatch.setattr(csv, "ONE_TASK_BYTES", 1000)
    expected = []
    for file in range(3):
        lines = ["h1,h2,h3"]
        for i in range(300):
            key = file * 1000 + i
            text = f"t{i}" if i % 3 else 'a ""q"", ' + "line\r\n" * (i % 50) + '""'
            lines.append(f'{key},"{text}",{i}')
            expected.append((str(key), text.replace('""', '"'), i))
        (tmp_path / f"{file}.csv").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    loaded = csv.load_positional(
        spark, str(tmp_path), COLUMNS, spanning=spanning, source_order="o"
    )
    assert [tuple(r)[:3] for r in loaded.orderBy("o").collect()] == expected


@pytest.mark.parametrize(
    "text",
    [
        'a,b,n\n1,"x,2\n3,y,4\n',  # inner column
        'a,b,n\n1,y,"2\n3,y,4\n',  # last column
        'a,b,n\r\n1,"x,2\r\n3,y,4\r\n',
        'a,b,n\n1,"x ""y"",2\n',
        '"a,b,n\n1,x,2\n',  # in the header
    ],
)
def test_unterminated_quote_fails(spark, tmp_path, text, reading):
    path = write(tmp_path, text)
    with pytest.raises(Exception, match="unterminated"):
        csv.load_positional(spark, path, COLUMNS, spanning=reading).collect()


def test_unterminated_quote_fails_by_name(spark, tmp_path, reading):
    write(tmp_path, "nama,peran\na,b\n", "1.csv")
    write(tmp_path, 'nama,peran\na,"b\nc,d\n', "2.csv")
    with pytest.raises(Exception, match=r"unterminated quoted field in \S+2\.csv"):
        csv.load_by_name(spark, str(tmp_path), ALLOWED, spanning=reading).collect()


def test_line_breaks_against_the_word_of_the_caller(spark, tmp_path):
    path = write(tmp_path, 'a,b,n\n1,"x\ny",2\n')
    assert rows(csv.load_positional(spark, path, COLUMNS)) == [("1", "x\ny", 2)]
    with pytest.raises(ValueError, match="spanning=False"):
        csv.load_positional(spark, path, COLUMNS, spanning=False)


def test_unclosed_files(spark, tmp_path):
    write(tmp_path, 'a\n"x\n', "1.csv")
    write(tmp_path, 'a\n"x\ny"\n', "2.csv")
    found = csv.unclosed_files(spark, str(tmp_path)).collect()
    assert sorted((r["file"][-5:], r["unclosed"]) for r in found) == [("1.csv", True), ("2.csv", False)]


def test_large_files_without_breaks_are_split(spark, conf, tmp_path, monkeypatch):
    conf(files__maxPartitionBytes=2000, files__openCostInBytes=1)
    monkeypatch.setattr(csv, "ONE_TASK_BYTES", 1000)
    path = write(tmp_path, "a,b,n\n" + '"x",y,1\n' * 2000)
    loaded = csv.load_positional(spark, path, COLUMNS)
    assert loaded.count() == 2000
    assert loaded.rdd.getNumPartitions() > 3


def test_mixed_files(spark, tmp_path):
    write(tmp_path, "nama;peran\r\na;b\r\n", "1 one.csv")
    write(tmp_path, "PERAN\tnama\tkabupaten\nc\t\"d\te\"\tf\n", "2+.csv")
    write(tmp_path, '\ufeffkabupaten,"Nama"\n"g\nh",i\n', "3%20.csv")
    write(tmp_path, "nama;peran\nj;k\n", "4.csv")
    write(tmp_path, "", "5.csv")
    loaded = csv.load_mixed_by_name(spark, str(tmp_path), ALLOWED, source_order="o")
    assert [tuple(r)[:3] for r in loaded.orderBy("o").collect()] == [
        ("a", None, "b"), ("d\te", "f", "c"), ("i", "g\nh", None), ("j", None, "k"),
    ]
    write(tmp_path, "umur;nama\n1;x\n", "6.csv")
    with pytest.raises(ValueError, match="unknown columns"):
        csv.load_mixed_by_name(spark, str(tmp_path), ALLOWED)
    assert csv.load_mixed_by_name(spark, str(tmp_path), ALLOWED, on_unknown="drop").count() == 5
    write(tmp_path, 'nama\n"y\n', "7.csv")
    with pytest.raises(ValueError, match="unterminated"):
        csv.load_mixed_by_name(spark, str(tmp_path), ALLOWED, on_unknown="drop")


def test_first_lines_are_found_without_sorting_lines(spark, tmp_path):
    for i in range(300):  # more files than a hash map of objects takes
        (tmp_path / f"{i:03}.csv").write_text(f"h{i}\r\n" + "a line\n" * (i % 7))
    (tmp_path / "none.csv").write_text("")
    found = csv.first_lines(spark, str(tmp_path))
    assert {r["header"] for r in found.collect()} == {f"h{i}" for i in range(300)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
