"""The registry's requests on small invented tables."""

import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_workbook import make_workbook

from rollbook import registry, tables
from rollbook.sources import store

NOW = datetime.datetime(2024, 6, 1)


def table(spark, schema, data):
    """Rows given as dicts, the rest of the columns null."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    return spark.createDataFrame([tuple(d.get(f.name) for f in schema.fields) for d in data], schema)


@pytest.fixture(scope="module")
def schools(spark):
    return table(
        spark,
        tables.SCHOOLS.schema,
        [
            {"sekolah_id": "S1", "nama": "SD Satu", "npsn": "1", "email": "a@x"},
            {"sekolah_id": "S2", "nama": "SMP Dua"},
            {"sekolah_id": "S3"},
        ],
    )


@pytest.fixture(scope="module")
def staff(spark):
    return table(
        spark,
        tables.STAFF.schema,
        [{"ptk_id": f"P{i}", "sekolah_id": "s1" if i < 13 else "S2", "nama": f"Guru {i % 5}",
          "nip": f"19{i:03d}", "jenis_kelamin": "LP"[i % 2]} for i in range(15)],
    )


@pytest.fixture(scope="module")
def users(spark):
    return table(
        spark,
        tables.USERS,
        [
            {"id": 1, "nip": "11", "nama": "Ani", "password": "h", "role": "admin"},
            {"id": 2, "nip": "22", "nama": "Budi", "password": "h", "role": "user"},
        ],
    )


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([(5, "Tim A"), (6, "Tim B")], tables.TEAMS)


@pytest.fixture(scope="module")
def activities(spark):
    day = datetime.datetime(2024, 1, 1)
    return table(
        spark,
        tables.ACTIVITIES,
        [
            {"id": 1, "users_id": 1, "nama_kegiatan": "Rapat", "team_id": 5, "created_at": day},
            {"id": 2, "users_id": 2, "nama_kegiatan": "rapat kerja", "created_at": None},
            {"id": 3, "users_id": 99, "nama_kegiatan": "Rapat hilang", "created_at": day},
            {"id": 4, "users_id": 2, "nama_kegiatan": "Lomba", "team_id": 77, "created_at": day},
        ],
    )


@pytest.fixture(scope="module")
def participants(spark):
    return table(
        spark,
        tables.PARTICIPANTS,
        [
            {"peserta_id": 1, "kegiatan_id": 1, "nama": "x"},
            {"peserta_id": 2, "kegiatan_id": 1, "nama": "A%"},
            {"peserta_id": 3, "kegiatan_id": 2, "nama": None},
        ],
    )


def test_column_lists():
    assert len(tables.SCHOOL_UPDATES) == len(set(tables.SCHOOL_UPDATES)) == 44
    assert len(tables.STAFF_UPDATES) == len(set(tables.STAFF_UPDATES)) == 48
    assert len(tables.CANDIDATE_UPDATES) == len(set(tables.CANDIDATE_UPDATES)) == 18


def test_school_lists(schools):
    assert rows(registry.list_schools(schools, 2, 2).rows, "sekolah_id") == [("S3",)]
    assert rows(registry.search_schools(schools, "s2").rows, "sekolah_id") == [("S2",)]
    assert rows(registry.search_schools(schools, "s").rows, "sekolah_id") == [("S1",), ("S2",)]
    assert registry.search_schools(schools).summary.first()["total"] == 2


def test_school_with_staff(schools, staff):
    row = registry.school_with_staff(schools, staff, "S1", "guru", "2", "5").first()
    assert row["sekolah_id"] == "s1"
    assert (row["sekolah_terpilih"], row["npsn"], row["email"]) == ("SD Satu", "1", "a@x")
    assert (row["totalData"], row["totalPages"], row["page"], row["limit"]) == (13, 3, 2, 5)
    assert [c["ptk_id"] for c in row["data_ptk"]] == ["P6", "P12", "P2", "P7", "P3"]
    assert list(row["data_ptk"][0].asDict()) == tables.STAFF_SHOWN
    assert registry.school_with_staff(schools, staff, "nope").count() == 0
    every = registry.schools_with_staff(schools, staff, "guru", 2, 5)
    assert {r["sekolah_id"]: r["totalData"] for r in every.collect()} == {"s1": 13, "s2": 2, "s3": 0}
    assert every.filter("sekolah_id = 's1'").first() == row


def test_staff_lists(staff):
    assert registry.list_staff(staff, limit=4).rows.count() == 4
    assert registry.search_staff(staff, "p3").rows.first()["ptk_id"] == "P3"
    assert registry.search_staff(staff, "19").summary.first()["total"] == 15
    shown, total = registry.staff_statistics(staff)
    assert shown.columns == tables.STAFF_STATISTICS
    assert total.first()[0] == 15
    counts = registry.staff_distribution(staff).filter("dimension = 'jenis_kelamin'")
    assert rows(counts, "value", "n") == [("L", 8), ("P", 7)]


def test_candidates(spark):
    data = [{"no": str(n), "no_ukg": f"u{n}", "tahun": "2024", "nama_lengkap": f"N{n}"} for n in (10, 9, 100)]
    df = table(spark, tables.CANDIDATES.schema, data)
    listed = registry.list_candidates(df).rows.collect()
    assert [r["no"] for r in listed] == ["9", "10", "100"]
    assert {r["lptk"] for r in listed} == {""}
    assert rows(registry.search_candidates(df, "", " n1 ").rows, "no") == [("10",), ("100",)]
    assert rows(registry.search_candidates(df, "n9", "n1").rows, "no") == [("9",)]


def test_activity_lists(activities, users, teams):
    cut = registry.list_activities(activities, users, teams)
    assert [(r["id"], r["created_by"], r["tim"]) for r in cut.rows.collect()] == [
        (2, "Budi", None),
        (1, "Ani", "Tim A"),
        (4, "Budi", None),
    ]
    assert cut.rows.columns == tables.ACTIVITY_LISTED
    assert cut.summary.first()["total"] == 4
    found = registry.search_activities(activities, users, teams, " RAPAT ")
    assert [r["id"] for r in found.rows.collect()] == [2, 1]
    assert found.summary.first()["total"] == 3
    one = registry.activities_by_id(activities, users, teams, ["1abc", 3])
    assert rows(one, "id", "tim") == [(1, "Tim A")]
    with pytest.raises(ValueError, match="not a valid id"):
        registry.activities_by_id(activities, users, teams, ["abc"])


def test_participant_lists(participants):
    assert rows(registry.list_participants(participants).rows, "peserta_id") == [(1,), (2,), (3,)]
    assert rows(registry.search_participants(participants, "a\\%").rows, "peserta_id") == [(2,)]
    assert rows(registry.participants_by_id(participants, [3, 8]), "peserta_id") == [(3,)]


def test_users_with_codes(spark, users):
    links = spark.createDataFrame([(2, 1), (2, 2)], tables.USER_PERMISSIONS)
    permissions = spark.createDataFrame([(1, "b"), (2, "a")], tables.PERMISSIONS)
    found = registry.users_with_codes(users, links, permissions)
    assert {r["id"]: r["codes"] for r in found.collect()} == {1: [], 2: ["a", "b"]}
    listed, total = registry.list_users(users)
    assert "password" not in listed.columns
    assert total.first()[0] == 2


def test_insert_activities(spark, activities):
    new = spark.createDataFrame(
        [
            (1, 2, "ok", "5", "5"),
            (2, 2, "bad", "5", "6"),
            (3, 2, "text", "x", "6"),
            (4, 2, "none", "7", None),
            (5, 2, "more", "9 people", "8"),
        ],
        "seq int, users_id long, nama_kegiatan string, sasaran_peserta string, total_peserta string",
    )
    change, judged = registry.insert_activities(activities, new, NOW, ["seq"])
    assert rows(change.affected, "id", "nama_kegiatan", "sasaran_peserta", "created_at") == [
        (5, "ok", 5, NOW),
        (6, "more", 9, NOW),
    ]
    assert rows(judged.bad, "nama_kegiatan") == [("bad",), ("none",), ("text",)]


def test_insert_participants(spark, participants):
    columns = ["kegiatan_id", "nama", "kabupaten", "instansi", "jabatan", "peran"]
    new = spark.createDataFrame(
        [(2, "n", "k", "i", "j", None), (2, "", "k", "i", "j", "x"), (2, "m", "k", "i", "j", "ketua")],
        "kegiatan_id int, nama string, kabupaten string, instansi string, jabatan string, peran string",
    )
    change, judged = registry.insert_participants(participants, new, ["nama"])
    assert rows(change.affected, "peserta_id", "nama", "peran") == [(4, "m", "ketua"), (5, "n", "peserta")]
    assert judged.bad.count() == 1
    assert set(columns) <= set(judged.bad.columns)


def test_deletes(spark, activities, participants, teams):
    ask = "request_id int, {} long, user_id long, role string"
    one = spark.createDataFrame([(0, 4, 2, "user"), (1, 1, 2, "user")], ask.format("id"))
    assert rows(registry.delete_activities(activities, one).status, "request_id", "status") == [
        (0, "deleted"),
        (1, "refused"),
    ]
    own = spark.createDataFrame([(0, 3, 2, "user"), (1, 1, 2, "user")], ask.format("peserta_id"))
    assert rows(registry.delete_participants(participants, own, activities).after, "peserta_id") == [(1,), (2,)]
    group = spark.createDataFrame([(0, 1, 1, "user"), (1, 4, 2, "user")], ask.format("kegiatan_id"))
    emptied = registry.delete_activity_participants(participants, group, activities)
    assert rows(emptied.status, "request_id", "status", "rows") == [(0, "deleted", 2), (1, "already_empty", 0)]
    used = spark.createDataFrame([(0, 5), (1, 6)], "request_id int, id long")
    assert rows(registry.delete_teams(teams, used, activities).after, "id") == [(5,)]


def test_delete_users(spark, users, activities, participants):
    links = spark.createDataFrame([(1, 1), (2, 1)], tables.USER_PERMISSIONS)
    registry_tables = {
        "users": users,
        "user_permissions": links,
        "kegiatan": activities,
        "peserta": participants,
    }
    asked = spark.createDataFrame([(1,)], "id long")
    plain = registry.delete_users(registry_tables, asked)
    assert set(plain) == {"users", "user_permissions", "kegiatan"}
    assert rows(plain["kegiatan"].after, "id") == [(2,), (3,), (4,)]
    deep = registry.delete_users(registry_tables, asked, with_participants=True)
    assert rows(deep["peserta"].after, "peserta_id") == [(3,)]


def test_create_users(spark, users):
    links = spark.createDataFrame([(1, 1)], tables.USER_PERMISSIONS)
    permissions = spark.createDataFrame([(1, "b"), (2, "a")], tables.PERMISSIONS)
    asked = spark.createDataFrame(
        [
            (0, "33", "C", "h", None, ["a", "a", "zz"]),
            (1, "33", "D", "h", "admin", ["b"]),
            (2, "22", "E", "h", "", None),
            (3, "", "F", "h", "user", None),
            (4, "44", "G", "h", "boss", None),
            (5, "55", "H", "h", "admin", ["a", "b"]),
        ],
        "request_id int, nip string, nama string, password string, role string, codes array<string>",
    )
    change, new_links = registry.create_users(users, links, permissions, asked, NOW)
    assert rows(change.affected, "id", "nip", "nama", "role", "created_at") == [
        (3, "33", "C", "user", NOW),
        (4, "55", "H", "admin", NOW),
    ]
    assert rows(new_links) == [(1, 1), (3, 2), (4, 1), (4, 2)]
    assert rows(change.status, "request_id", "reason") == [
        (0, None),
        (1, "repeated"),
        (2, "known"),
        (3, "nip: missing"),
        (4, "role: not allowed"),
        (5, None),
    ]


def test_update_users(spark, users):
    links = spark.createDataFrame([(1, 1), (2, 1)], tables.USER_PERMISSIONS)
    asked = spark.createDataFrame(
        [
            (0, 1, "boss", [5]),
            (1, 2, "admin", [5, 6]),
            (2, 1, "", None),
            (3, 9, "user", [1]),
            (4, 1, "user", [7, 7]),
        ],
        "request_id int, id long, role string, ids array<long>",
    )
    change, sets = registry.update_users(users, links, asked, NOW)
    assert rows(change.after, "id", "role", "updated_at") == [(1, "admin", None), (2, "admin", NOW)]
    assert rows(sets.after) == [(1, 1), (2, 5), (2, 6)]
    assert rows(change.status, "request_id", "status") == [
        (0, "role: not allowed"),
        (1, "updated"),
        (2, "unchanged"),
        (3, "not_found"),
        (4, "ids: repeated"),
    ]


def test_teams(spark, teams):
    new = spark.createDataFrame([(0, "Tim A"), (1, "Tim C"), (2, "Tim C"), (3, "")], "seq int, nama_tim string")
    change = registry.insert_teams(teams, new, "seq")
    assert [tuple(r) for r in registry.list_teams(change.after).collect()] == [
        (5, "Tim A"),
        (6, "Tim B"),
        (7, "Tim C"),
    ]
    # The second team may take the name that the first has left, not the one it has taken.
    asked = spark.createDataFrame([(0, 5, "Tim Z"), (1, 6, "Tim A"), (2, 6, "Tim Z")], "seq int, id long, nama_tim string")
    renamed = registry.rename_teams(teams, asked, "seq")
    assert rows(renamed.status, "seq", "status") == [(0, "updated"), (1, "updated"), (2, "duplicate")]
    assert rows(renamed.after) == [(5, "Tim Z"), (6, "Tim A")]


def positional(schema, data):
    names = schema.fieldNames()
    lines = [",".join(f"c{i}" for i in range(len(names)))]
    lines += [",".join(d.get(n, "") for n in names) for d in data]
    return "\n".join(lines) + "\n"


def cells(values):
    return "".join(
        f'<c t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' if isinstance(v, str)
        else "<c/>" if v is None else f"<c><v>{v}</v></c>"
        for v in values
    )


def sheet(lines):
    return "".join(f'<row r="{i}">{cells(line)}</row>' for i, line in enumerate(lines, 1))


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_load_schools(spark, schools, tmp_path, kind):
    names = tables.SCHOOLS.schema.fieldNames()
    data = [
        {"sekolah_id": "S2", "nama": "Baru"},
        {"sekolah_id": "S2", "nama": "Kedua"},
        {"sekolah_id": "S9", "nama": "Sembilan"},
    ]
    path = tmp_path / f"schools.{kind}"
    if kind == "csv":
        path.write_text(positional(tables.SCHOOLS.schema, data))
    else:
        lines = [names, *[[d.get(n) for n in names] for d in data]]
        path.write_bytes(make_workbook({"S": sheet(lines)}))
    change = registry.load_schools(spark, str(path), schools)
    assert rows(change.after, "sekolah_id", "nama") == [
        ("S1", "SD Satu"),
        ("S2", "Baru"),
        ("S3", None),
        ("S9", "Sembilan"),
    ]
    blank = None if kind == "csv" else ""
    assert rows(change.affected, "email") == [(blank,), (blank,)]


def test_load_staff(spark, staff, tmp_path):
    path = tmp_path / "staff.csv"
    path.write_text(positional(tables.STAFF.schema, [{"ptk_id": "P1", "nama": "Lain"}]))
    change = registry.load_staff(spark, str(path), staff)
    assert rows(change.affected, "ptk_id", "nama", "nip") == [("P1", "Lain", None)]
    assert change.after.count() == 15


def test_load_candidates(spark, tmp_path):
    schema = tables.CANDIDATES.schema
    old = table(spark, schema, [{"no": "1", "no_ukg": "u", "tahun": "2023", "lptk": "old"}])
    names = schema.fieldNames()
    lines = [[n.upper().replace("_", " ") for n in names]]
    for no, year in ((5, 2023), (6, 2024)):
        lines.append([no, "u", year] + [None] * (len(names) - 3))
    path = tmp_path / "c.xlsx"
    path.write_bytes(make_workbook({"S": sheet(lines)}))
    change = registry.load_candidates(spark, str(path), old)
    assert rows(change.after, "no", "no_ukg", "tahun", "lptk") == [
        ("1", "u", "2023", None),
        ("6", "u", "2024", None),
    ]


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_load_participants(spark, participants, tmp_path, kind):
    path = tmp_path / f"p.{kind}"
    if kind == "csv":
        path.write_text('"NAMA";peran\n" a ";""\nb;\n')
    else:
        path.write_bytes(make_workbook({"S": sheet([[" NAMA", "peran"], [" a ", ""], ["b", None]])}))
    change = registry.load_participants(spark, str(path), participants, 9)
    blank = None if kind == "csv" else ""
    assert rows(change.affected, "peserta_id", "kegiatan_id", "nama", "peran", "alamat") == [
        (4, 9, "a", "", None),
        (5, 9, "b", blank, None),
    ]
    with pytest.raises(ValueError, match="kegiatan_id"):
        registry.load_participants(spark, str(path), participants, None)


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_load_activities(spark, activities, tmp_path, kind):
    values = [" Rapat ", "45292", "2024-01-03", "x", " 5 ", "y", "2024", "", "7"]
    path = tmp_path / f"a.{kind}"
    if kind == "csv":
        path.write_text("h1,h2,h3,h4,h5,h6,h7,h8,h9\n" + ",".join(values) + "\n")
    else:
        path.write_bytes(make_workbook({"S": sheet([tables.ACTIVITY_STAGED, [*values[:1], 45292, *values[2:]]])}))
    change = registry.load_activities(spark, str(path), activities, 2, NOW)
    top = activities.agg(F.max("id")).first()[0]
    assert rows(change.affected) == [
        (top + 1, 2, "Rapat", datetime.date(2024, 1, 1), datetime.date(2024, 1, 3), "x", 5, "y", 2024, None, 7, NOW, NOW)
    ]
    assert change.after.count() == 5


def test_load_activities_fails_whole(spark, activities, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b,c,d,e,f,g,h,i\nx,2024-02-30,,,,,,,\n")
    with pytest.raises(Exception, match="not a valid date"):
        registry.load_activities(spark, str(path), activities, 2, NOW).after.collect()
    lenient = registry.load_activities(spark, str(path), activities, 2, NOW, strict=False)
    assert rows(lenient.affected, "tanggal_mulai") == [(None,)]


def test_split_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('"k, 1",t\n' + "".join(f"{i},{i % 7}\n" for i in range(2100)))
    manifest = registry.split_csv(spark, str(path), str(tmp_path / "out"), "in")
    assert rows(manifest, "part", "n", "name") == [
        (1, 1000, "in_part1.csv"),
        (2, 1000, "in_part2.csv"),
        (3, 100, "in_part3.csv"),
    ]
    last = next((tmp_path / "out" / "name=in_part3.csv").glob("*.csv")).read_text().splitlines()
    assert last[:2] == ['"k, 1",t', "2000,5"]
    assert len(last) == 101


@pytest.mark.parametrize("bound", [None, 0])
def test_split_csv_with_line_breaks_in_quotes(spark, conf, tmp_path, bound):
    """Rows stay in the order of the file however it is read."""
    conf(adaptive__coalescePartitions__enabled="false", shuffle__partitions="8")
    path = tmp_path / "in.csv"
    path.write_text("k,t\n" + "".join(f'{i},"a\n""{i % 7}""\n"\n' for i in range(2500)))
    manifest = registry.split_csv(spark, str(path), str(tmp_path / "out"), "in", one_task_bytes=bound)
    assert rows(manifest, "part", "n", "name") == [
        (1, 1000, "in_part1.csv"),
        (2, 1000, "in_part2.csv"),
        (3, 500, "in_part3.csv"),
    ]
    for r in manifest.collect():
        keys = [x[0] for x in spark.read.csv(r["file"], header=True, multiLine=True, escape='"').select("k").collect()]
        assert keys == [str(i) for i in range((r["part"] - 1) * 1000, min(r["part"] * 1000, 2500))]


def test_merge_file(spark, tmp_path):
    schema = T.StructType.fromDDL("ptk_id string, nama string, nip string")
    table = tables.UpsertTable(["ptk_id"], ["nama"], schema)
    folder = str(tmp_path / "staff")
    for text in ("ptk_id,nama,nip\n1,a,x\n2,b,y\n", "ptk_id,nama,nip\n2,c,z\n2,d,z\n3,e,w\n"):
        (tmp_path / "in.csv").write_text(text)
        registry.merge_file(spark, str(tmp_path / "in.csv"), folder, table)
    assert rows(store.read_ranges(spark, folder)) == [("1", "a", "x"), ("2", "c", "y"), ("3", "e", "w")]
    (tmp_path / "in.csv").write_text("ptk_id,nama,nip\n4,f\n")
    with pytest.raises(Exception, match="MALFORMED"):
        registry.merge_file(spark, str(tmp_path / "in.csv"), folder, table)
    assert store.read_ranges(spark, folder).count() == 3


def test_clears(spark):
    held = {name: spark.range(3) for name in ("ptk", "data_sekolah", "kegiatan", "peserta")} | {"ppg": spark.range(0)}

    def left(result):
        return result.status, sorted(t for t, df in result.tables.items() if not df.isEmpty())

    assert left(registry.clear_staff(held)) == ("deleted", ["data_sekolah", "kegiatan", "peserta"])
    assert left(registry.clear_schools(held)) == ("deleted", ["kegiatan", "peserta"])
    assert left(registry.clear_activities(held)) == ("deleted", ["data_sekolah", "ptk"])
    assert left(registry.clear_candidates(held))[0] == "already_empty"


def test_users_by_id(spark, users):
    links = spark.createDataFrame([(2, 1), (2, 2), (2, 2)], tables.USER_PERMISSIONS)
    permissions = spark.createDataFrame([(1, "b"), (2, "a")], tables.PERMISSIONS)
    requests = spark.createDataFrame([(1, 2), (2, 77), (3, 2)], "request_id int, id bigint")
    found, status = registry.users_by_id(users, links, permissions, requests)
    assert [(r["id"], r["codes"]) for r in found.collect()] == [(2, ["a", "b"])]
    assert rows(status, "request_id", "status") == [(1, "found"), (2, "not_found"), (3, "found")]
    some = registry.users_with_codes(users, links, permissions, [1])
    assert [(r["id"], r["codes"]) for r in some.collect()] == [(1, [])]


def test_schema_types_are_plain(spark):
    assert isinstance(tables.SCHOOLS.schema, T.StructType)
    empty = spark.createDataFrame([], tables.ACTIVITIES)
    assert empty.select(F.col("sasaran_peserta")).schema[0].dataType == T.IntegerType()
