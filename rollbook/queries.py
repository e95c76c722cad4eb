"""The registered queries: every operator on the given tables.

Roles of the tables: a school is a customer, staff and activities are orders,
participants are line items, users are customers or suppliers, permissions are
parts, and teams are nations.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import registry, tables
from rollbook.functions.predicates import matches, search
from rollbook.functions.text import blank_nulls, header_column, trim_all
from rollbook.functions.typed import exact_int, leading_int, mixed_date, strict_int
from rollbook.operators import access, change, delete, listing, split, stats, validate
from rollbook.operators.children import children_page as one_parent
from rollbook.operators.children import children_pages as every_parent
from rollbook.operators.listing import Lookup
from rollbook.operators.rename import rename_unique as rename
from rollbook.operators.search import search_batch
from rollbook.plans import rank_in_group, stage_path
from rollbook.sources import csv, store
from rollbook.streaming import ingest_dir as ingest_files

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime.datetime(2024, 6, 1)
LINE_ORDER = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _customer_name(key: str) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def _doubled(df: DataFrame, key: str) -> DataFrame:
    """Only even keys, so that half of the references to them find no row."""
    return df.withColumn(key, F.col(key) * 2)


def _day(c: str) -> Column:
    return F.to_date(F.col(c))


# --- reads ---------------------------------------------------------------


def page_list(spark: SparkSession, sf: str) -> DataFrame:
    supplier = _read(spark, sf, "supplier")
    return listing.page(supplier, ["s_suppkey"], "s_suppkey", "3", "10").with_totals()


def page_envelope(spark: SparkSession, sf: str) -> DataFrame:
    part = _read(spark, sf, "part").select("p_partkey", "p_name")
    cut = listing.page(part, ["p_name"], "p_partkey", "2abc", "0").envelope()
    keys = F.transform("data", lambda row: row["p_partkey"].cast("string"))
    return cut.select("page", "limit", "total", "pages", F.array_join(keys, ",").alias("keys"))


def user_list(spark: SparkSession, sf: str) -> DataFrame:
    customer = _read(spark, sf, "customer")
    rows = customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nama"), "c_mktsegment"
    )
    return rows.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def search_multi(spark: SparkSession, sf: str) -> DataFrame:
    terms = [("c_name", "exact"), ("c_name", "contains"), ("c_mktsegment", "contains")]
    return search(_read(spark, sf, "customer"), terms, "mach")


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(_read(spark, sf, "part"), [("p_name", "contains")], "  RING ", trim=True)
    return listing.page(hits, ["p_name"], "p_partkey", 2, 15).with_totals()


def search_pattern(spark: SparkSession, sf: str) -> DataFrame:
    part = _read(spark, sf, "part").select("p_partkey", "p_name")

    def labelled(label: str, q: str, literal: bool) -> DataFrame:
        hits = part.filter(matches([("p_name", "contains")], q, literal=literal))
        return hits.withColumn("form", F.lit(label))

    return (
        labelled("live", "r_ng", False)
        .unionByName(labelled("literal", "r_ng", True))
        .unionByName(labelled("escape", "r\\ing", False))
        .unionByName(labelled("percent", "ring\\", False))
    )


def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents")
    terms = [("lang", "exact"), ("source", "contains"), ("text", "contains")]
    return search(documents, terms, "DE").select("doc_id", "lang", "source", "n_chars")


def search_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Texts taken from documents of each source and language, some with wildcards, searched in all documents."""
    documents = _read(spark, sf, "documents")
    head, tail = F.min(F.substr("text", F.lit(21), F.lit(9))), F.max(F.substr("text", F.lit(41), F.lit(6)))
    texts = documents.groupBy("source", "lang").agg(head.alias("head"), tail.alias("tail"))
    forms = F.array(
        F.struct(F.lit("head").alias("form"), F.col("head").alias("q")),
        F.struct(F.lit("short").alias("form"), F.substr("tail", F.lit(1), F.lit(2)).alias("q")),
        F.struct(F.lit("two").alias("form"), F.concat_ws("%", F.substr("head", F.lit(1), F.lit(5)), "tail").alias("q")),
        F.struct(F.lit("one").alias("form"), F.concat("tail", F.lit("_"), "source").alias("q")),
    )
    requests = texts.select("source", "lang", F.explode(forms).alias("x")).select(
        F.concat_ws(" ", "source", "lang", "x.form").alias("request_id"), F.translate("x.q", "aeiou", "AEIOU").alias("q")
    )
    terms = [("text", "contains"), ("source", "exact")]
    return search_batch(documents, requests, terms, "doc_id")


def _activities(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("nama_kegiatan"),
        _day("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("users_id"),
        (F.col("o_orderkey") % 30).cast("int").alias("team_id"),
    )


def _activity_lookups(spark: SparkSession, sf: str) -> list[Lookup]:
    users = _doubled(_read(spark, sf, "customer"), "c_custkey")
    teams = _read(spark, sf, "nation")
    return [
        Lookup(users, "users_id", "c_custkey", {"c_name": "created_by"}, "inner"),
        Lookup(teams, "team_id", "n_nationkey", {"n_name": "tim"}, "left"),
    ]


def page_lookups(spark: SparkSession, sf: str) -> DataFrame:
    return listing.lookup_page(
        _activities(spark, sf),
        _activity_lookups(spark, sf),
        [("created_at", "desc")],
        "id",
        2,
        10,
    ).with_totals()


def search_lookups(spark: SparkSession, sf: str) -> DataFrame:
    found = search(_activities(spark, sf), [("nama_kegiatan", "contains")], " urg ", trim=True)
    lookups = _activity_lookups(spark, sf)
    order = [("created_at", "desc")]
    return listing.lookup_page(found, lookups, order, "id", 3, 25, "joined").with_totals()


def all_lookups(spark: SparkSession, sf: str) -> DataFrame:
    return listing.with_lookups(_activities(spark, sf), _activity_lookups(spark, sf))


def totals_base_joined(spark: SparkSession, sf: str) -> DataFrame:
    fact, lookups = _activities(spark, sf), _activity_lookups(spark, sf)

    def summary(total: str) -> DataFrame:
        cut = listing.lookup_page(fact, lookups, [("created_at", "desc")], "id", 1, 7, total)
        return cut.summary.withColumn("kind", F.lit(total))

    return summary("base").unionByName(summary("joined"))


def by_key_set(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _read(spark, sf, "events").select("user_id")
    orders = _read(spark, sf, "orders").withColumn("o_orderdate", _day("o_orderdate"))
    return listing.by_key(orders, "o_custkey", wanted)


def by_key_text(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.regexp_replace("props", "[^0-9]+", "")
    ids = _read(spark, sf, "events").select(
        leading_int(F.concat(F.lit(" "), asked, F.lit("abc"))).alias("id")
    )
    return listing.by_key(_read(spark, sf, "customer"), "c_custkey", ids)


def _schools_and_staff(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    school = _read(spark, sf, "customer")
    staff = _read(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.upper(_customer_name("o_custkey")).alias("sekolah_id"),
    )
    return school, staff


def _row_keys(key: str) -> Column:
    keys = F.transform("data", lambda row: row[key].cast("string"))
    return F.array_join(keys, ",").alias("keys")


def children_page(spark: SparkSession, sf: str) -> DataFrame:
    school, staff = _schools_and_staff(spark, sf)
    return one_parent(
        school,
        staff,
        "CUSTOMER#000000007",
        "c_name",
        "sekolah_id",
        ["o_orderpriority"],
        "o_orderkey",
        [("o_orderpriority", "contains")],
        "i",
        1,
        3,
        parent_columns=["c_custkey", "c_mktsegment"],
    ).select(
        "c_custkey",
        "c_mktsegment",
        "parent_id",
        "total",
        "pages",
        "page",
        "limit",
        _row_keys("o_orderkey"),
    )


def children_pages(spark: SparkSession, sf: str) -> DataFrame:
    school, staff = _schools_and_staff(spark, sf)
    return every_parent(
        school,
        staff,
        "c_name",
        "sekolah_id",
        ["o_orderpriority"],
        "o_orderkey",
        page_no=2,
        limit=3,
        parent_columns=["c_custkey"],
        child_columns=["o_orderkey"],
    ).select("c_custkey", "parent_id", "total", "pages", _row_keys("o_orderkey"))


def children_pages_long(spark: SparkSession, sf: str) -> DataFrame:
    """Pages too long for the early cut."""
    part = _read(spark, sf, "part")
    brand = part.select(F.upper("p_brand").alias("brand")).distinct()
    return every_parent(
        brand,
        part.select("p_partkey", "p_name", "p_brand"),
        "brand",
        "p_brand",
        ["p_name"],
        "p_partkey",
        limit=1000,
    ).select("brand", "total", "pages", _row_keys("p_partkey"))


def cast_order_blank(spark: SparkSession, sf: str) -> DataFrame:
    candidates = _read(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("no"),
        F.when(F.col("p_size") >= 10, F.col("p_brand")).alias("lptk"),
        F.when(F.col("p_size") < 40, F.col("p_size")).alias("tahap"),
    )
    cut = listing.page(candidates, [(exact_int(F.col("no")), "asc")], "no", 5, 20)
    return blank_nulls(cut.rows)


def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders").select("o_orderkey", _day("o_orderdate").alias("day"))
    return listing.all_pages(orders, [("day", "desc")], "o_orderkey", 100)


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    people = _read(spark, sf, "customer").withColumn(
        "c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))
    )
    return stats.distribution(people, ["c_mktsegment", "c_nationkey"])


def cross_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs and the triple of three dimensions, one of them with very many values."""
    orders = _read(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.col("o_custkey").alias("customer"),
    )
    return stats.cross_distribution(orders, ["status", "priority", "customer"], [2, 3], 12)


def statistics_feed(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = _read(spark, sf, "lineitem")
    rows, total = stats.feed(lineitem, ["l_orderkey", "l_linenumber", "l_returnflag"])
    return rows.withColumn("total", total.scalar())


# --- access --------------------------------------------------------------


def _links(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = _read(spark, sf, "lineitem")
    return lineitem.select(
        F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("permission_id")
    ).distinct()


def _permissions(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))
    return _read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 7, code).alias("code")
    )


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("nama")
    )


def codes_per_user(spark: SparkSession, sf: str) -> DataFrame:
    listed = access.codes_per_user(_users(spark, sf), _links(spark, sf), _permissions(spark, sf))
    return listed.select("id", "nama", F.array_join("codes", ",").alias("codes"))


def codes_of_one_user(spark: SparkSession, sf: str) -> DataFrame:
    """Two users that exist and one that does not."""
    requests = _read(spark, sf, "supplier").agg(F.max("s_suppkey").alias("top")).select(
        F.explode(F.array(F.lit(1), F.lit(7), F.col("top") + 1).cast("array<bigint>")).alias("id")
    )
    users, status = access.codes_of_requested(
        _users(spark, sf),
        _links(spark, sf),
        _permissions(spark, sf),
        requests.withColumn("request_id", F.col("id") * 10),
    )
    found = users.select("id", "nama", F.array_join("codes", ",").alias("codes"))
    return found.unionByName(
        status.select("id", F.col("status").alias("nama"), F.lit("").alias("codes"))
    )


def codes_of_requested(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each line item; half of the users asked for are unknown."""
    requests = _read(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("request_id"),
        (F.col("l_suppkey") * 2).alias("id"),
    )
    users, status = access.codes_of_requested(
        _users(spark, sf), _links(spark, sf), _permissions(spark, sf), requests
    )
    found = users.select("id", "nama", F.array_join("codes", ",").alias("codes"))
    return found.unionByName(
        status.select("id", F.col("status").alias("nama"), F.col("request_id").alias("codes"))
    )


def codes_in_rows(spark: SparkSession, sf: str) -> DataFrame:
    return access.codes_in_rows(_links(spark, sf), _permissions(spark, sf))


def permission_codes(spark: SparkSession, sf: str) -> DataFrame:
    return access.permission_codes(_links(spark, sf), _permissions(spark, sf))


def has_access(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("c_acctbal") > 9000, "admin").when(F.col("c_acctbal") > 0, "user")
    users = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), role.alias("role"))
    links = _doubled(_read(spark, sf, "orders"), "o_custkey")
    return access.has_access(users, links, user="o_custkey")


def replace_set(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    ids = (
        F.when(F.col("c_nationkey") % 4 == 0, F.lit(None).cast("array<bigint>"))
        .when(F.col("c_nationkey") % 4 == 1, F.array().cast("array<bigint>"))
        .when(F.col("c_nationkey") % 4 == 2, F.array(key, key))
        .otherwise(F.array(key, key + 1, key + 2))
    )
    requests = _read(spark, sf, "customer").select(
        key.alias("request_id"), F.floor(key / 4).alias("user_id"), ids.alias("ids")
    )
    result = access.replace_set(_links(spark, sf), requests, _users(spark, sf), "request_id")
    links = result.after.select(F.lit("link").alias("kind"), "user_id", "permission_id")
    counts = result.status.groupBy("status").count()
    return links.unionByName(
        counts.select(
            F.col("status").alias("kind"),
            F.lit(-1).cast("bigint").alias("user_id"),
            F.col("count").alias("permission_id"),
        )
    )


def assign_codes(spark: SparkSession, sf: str) -> DataFrame:
    permissions = _permissions(spark, sf)
    lines = _read(spark, sf, "lineitem").join(
        permissions, F.col("l_partkey") == F.col("id")
    )
    requests = lines.select(
        (F.col("l_suppkey") + F.col("l_linenumber")).alias("user_id"),
        F.array(F.col("code"), F.lit("unknown"), F.col("code")).alias("codes"),
    )
    links, status = access.assign_codes(_users(spark, sf), requests, permissions)
    counts = status.groupBy("status").count()
    return links.select(F.lit("link").alias("kind"), "user_id", "permission_id").unionByName(
        counts.select(
            F.col("status").alias("kind"),
            F.lit(-1).cast("bigint").alias("user_id"),
            F.col("count").alias("permission_id"),
        )
    )


# --- loads ---------------------------------------------------------------


def dedupe_by_key(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = _read(spark, sf, "lineitem").withColumn("l_shipdate", _day("l_shipdate"))
    return change.dedupe_by_key(lineitem, ["l_orderkey", "l_linenumber"], LINE_ORDER)


def _upsert(spark: SparkSession, sf: str, **options) -> DataFrame:
    target = (
        _doubled(_read(spark, sf, "orders"), "o_orderkey")
        .select(
            F.col("o_orderkey").alias("k"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("note"),
            F.col("o_totalprice").alias("amount"),
        )
    )
    staged = _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.nullif("l_returnflag", F.lit("R")).alias("status"),
        F.col("l_linestatus").alias("note"),
        F.col("l_extendedprice").alias("amount"),
        *LINE_ORDER[1:],
    )
    result = change.upsert(target, staged, ["k"], ["status", "amount"], LINE_ORDER[1:], **options)
    return result.after


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upsert(spark, sf)


def upsert_large(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge with a batch that is taken as too large to broadcast."""
    return _upsert(spark, sf, small=0)


def _date_text() -> Column:
    day = _day("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    turn = F.col("o_orderkey") % 5
    return (
        F.when(turn == 0, F.concat(F.lit(" "), serial, F.lit(" ")))
        .when(turn == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(turn == 2, F.lit("   "))
        .when(turn == 3, F.date_format(day, "dd/MM/yyyy"))
    )


def normalise_dates(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders").select("o_orderkey", _date_text().alias("raw"))
    return orders.withColumns(
        {
            "mulai": mixed_date(F.col("raw")),
            "guarded": mixed_date(F.col("raw"), min_serial=36000, strict=False),
        }
    )


def _size_text() -> Column:
    size = F.col("p_size").cast("string")
    return (
        F.when(F.col("p_size") < 10, F.concat(F.lit("  "), size, F.lit(" ")))
        .when(F.col("p_size") < 20, F.lit("  "))
        .when(F.col("p_size") < 45, size)
    )


def normalise_ints(spark: SparkSession, sf: str) -> DataFrame:
    part = _read(spark, sf, "part").select(
        "p_partkey",
        _size_text().alias("raw"),
        F.concat(F.lit("  "), F.col("p_name"), F.lit("  ")).alias("p_name"),
    )
    return trim_all(part, ["p_name"]).withColumns(
        {
            "strict": strict_int(F.col("raw")),
            "lenient": strict_int(F.concat(F.col("raw"), F.lit("x")), strict=False),
            "leading": leading_int(F.concat(F.col("raw"), F.lit("x9"))),
        }
    )


def append_normalised(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders")
    target = orders.select(
        F.col("o_custkey").alias("users_id"),
        F.col("o_orderpriority").alias("nama_kegiatan"),
        _day("o_orderdate").alias("tanggal_mulai"),
        F.col("o_orderkey").cast("int").alias("tahun"),
        F.lit(datetime.datetime(2024, 1, 1)).alias("created_at"),
    )
    staged = orders.select(
        F.concat(F.lit(" "), F.col("o_orderstatus")).alias("nama_kegiatan"),
        mixed_date(_date_text()).alias("tanggal_mulai"),
        strict_int(F.concat(F.col("o_orderkey").cast("string"), F.lit(" "))).alias("tahun"),
    )
    added = change.append(
        target, trim_all(staged, ["nama_kegiatan"]), constants={"users_id": 7}, now=NOW
    )
    return added.after.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def _write_customers(spark: SparkSession, sf: str) -> str:
    nick = F.when(F.col("c_nationkey") % 3 == 0, F.lit("")).when(
        F.col("c_nationkey") % 3 == 1, F.concat(F.lit('a "b", '), "c_mktsegment", F.lit("\nx"))
    )
    path = stage_path(spark, "customers-csv")
    _read(spark, sf, "customer").select(
        F.col("c_custkey").alias("wrong"),
        F.col("c_name").alias("names"),
        F.col("c_acctbal").alias("here"),
        nick.alias("nick"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return path


def csv_positional(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal double, nick string")
    return csv.load_positional(spark, _write_customers(spark, sf), schema)


def csv_by_name(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "participants-csv")
    _read(spark, sf, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("NAMA"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("Peran"),
        F.concat(F.lit("a;b "), "l_returnflag").alias(" Jabatan "),
    ).write.option("header", True).option("sep", ";").option("quoteAll", True).csv(path)
    allowed = ["nama", "kabupaten", "instansi", "jabatan", "alamat", "jenjang", "peran"]
    loaded = csv.load_by_name(spark, path, allowed)
    return trim_all(loaded, allowed).withColumn("sep", F.lit(csv.sniff_delimiter(spark, path)))


def csv_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Files with three delimiters and column orders in one folder."""
    path = stage_path(spark, "mixed-csv")
    lines = _read(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("NAMA"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("Peran"),
        F.concat(F.lit("x;y,"), "l_returnflag").alias("jabatan"),
        F.col("l_linenumber").alias("nth"),
    )
    for nth, sep, columns in ((0, ";", ["Peran", "NAMA", "jabatan"]), (1, "\t", ["jabatan", "NAMA"]), (2, ",", ["NAMA", "Peran"])):
        mine = lines.filter(F.col("nth") % 3 == nth).select(*columns)
        mine.write.mode("append").option("header", True).option("sep", sep).csv(path)
    return csv.load_mixed_by_name(spark, path, ["nama", "peran", "jabatan"])


def csv_unclosed(spark: SparkSession, sf: str) -> DataFrame:
    """Which brands' files have a quote that never closes, and what their loads say at either size."""
    path = stage_path(spark, "unclosed-csv")
    opened = F.when(F.col("p_size") % 7 == 0, F.lit('"')).otherwise(F.lit(""))
    line = F.concat(opened, "p_name", F.lit(","), F.col("p_partkey").cast("string"))
    part = _read(spark, sf, "part").select("p_brand", line.alias("line"))
    part.repartition("p_brand").write.partitionBy("p_brand").text(path)
    files = csv.unclosed_files(spark, path)
    brand = F.url_decode(F.url_decode(F.regexp_extract("file", "p_brand=([^/]+)/", 1)))

    def outcome(one_task_bytes: int) -> str:
        try:
            csv.load_positional(spark, path, T.StructType.fromDDL("n string, k string"), one_task_bytes=one_task_bytes)
        except ValueError as error:
            return str(error).partition(" in ")[0]
        return "loaded"

    return files.select(
        brand.alias("brand"), "unclosed", F.lit(outcome(csv.ONE_TASK_BYTES)).alias("whole"), F.lit(outcome(0)).alias("pieces")
    )


def header_rules(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(' "'), F.col("c_mktsegment"), F.lit(" \t Of  "), "c_name", F.lit('"\r'))
    names = _read(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    rules = {rule: header_column(F.col("raw"), rule) for rule in ("trim_lower", "underscore")}
    return names.withColumns({**rules, "unquote": header_column(F.col("raw"), "unquote")}).drop(
        "raw"
    )


def publish_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    table = stage_path(spark, "versions")
    part = _read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    store.publish(part, table)
    newest = store.read_version(spark, table)
    changed = newest.withColumn("p_size", F.col("p_size") + 1)
    store.publish(changed, table)
    store.publish(part, table, 1)  # published before, so left as it is
    return store.read_version(spark, table)


def merge_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A table by key range that takes all orders, then the changed upper third of the keys and as many new ones."""
    table = stage_path(spark, "ranges")
    orders = _read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note")
    )
    n = orders.count()
    store.merge(orders.withColumn("o", F.col("k")), table, ["k"], ["status"], ["o"], rows_per_range=n // 10 + 1)
    top = orders.agg(F.max("k")).scalar()
    shift = F.when(F.col("k") % 2 == 0, 0).otherwise(top)
    late = orders.filter(F.col("k") * 3 > top * 2).select(
        (F.col("k") + shift).alias("k"), F.concat(F.lit("late "), "status").alias("status"), F.lit("new").alias("note")
    )
    store.merge(late.withColumn("o", F.col("k")), table, ["k"], ["status"], ["o"], rows_per_range=n // 10 + 1)
    return store.read_ranges(spark, table)


def ingest_dir(spark: SparkSession, sf: str) -> DataFrame:
    folder = stage_path(spark, "ingest")
    schema = T.StructType.fromDDL("k bigint, status string, note string")
    orders = _read(spark, sf, "orders")
    known = _doubled(orders, "o_orderkey").select(
        F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority"
    )
    lines = change.dedupe_by_key(
        _read(spark, sf, "lineitem"), ["l_orderkey"], LINE_ORDER
    ).select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linestatus")
    table = None
    for arriving in (known, lines):
        arriving.write.mode("append").option("header", True).csv(f"{folder}/in")
        table = ingest_files(
            spark, f"{folder}/in", schema, ["k"], ["status"], f"{folder}/table", f"{folder}/log"
        )
    return table


# --- changes -------------------------------------------------------------


def _requests(spark: SparkSession, sf: str, key: str) -> DataFrame:
    role = F.when(F.col("event_type") == "error", "admin").otherwise("user")
    return _read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.shiftright("event_id", 1).alias(key),
        (F.col("user_id") % 25).cast("int").alias("user_id"),
        role.alias("role"),
    )


def _statuses_and_rows(status: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return status.select(
        F.lit("request").alias("kind"), F.col("request_id").alias("id"), "status"
    ).unionByName(
        rows.select(
            F.lit("kept").alias("kind"), F.col(key).alias("id"), F.lit("").alias("status")
        )
    )


def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    target = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = _read(spark, sf, "orders")
    # Every key is asked for twice, and half of the keys are unknown.
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"),
        (F.floor(F.col("o_orderkey") / 2) * 4).alias("l_orderkey"),
    )
    result = delete.delete_by_key(target, requests, ["l_orderkey"])
    no_line = F.lit(None).cast("bigint")
    statuses = result.status.select(
        F.col("request_id").alias("l_orderkey"),
        F.lit(None).cast(target.schema["l_linenumber"].dataType).alias("l_linenumber"),
        no_line.alias("l_partkey"),
        F.col("status").alias("side"),
    )
    return (
        result.after.withColumn("side", F.lit("after"))
        .unionByName(result.affected.withColumn("side", F.lit("affected")))
        .unionByName(statuses)
    )


def delete_owned(spark: SparkSession, sf: str) -> DataFrame:
    target = _read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("users_id")
    )
    result = delete.delete_scoped(
        target, _requests(spark, sf, "o_orderkey"), "o_orderkey", "users_id"
    )
    return _statuses_and_rows(result.status, result.after, "o_orderkey")


def delete_scoped(spark: SparkSession, sf: str) -> DataFrame:
    result = delete.delete_scoped(
        _read(spark, sf, "orders"),
        _requests(spark, sf, "o_orderkey"),
        "o_orderkey",
        "c_nationkey",
        owners=_read(spark, sf, "customer"),
        owner_link=("o_custkey", "c_custkey"),
    )
    return _statuses_and_rows(result.status, result.after, "o_orderkey")


def delete_group(spark: SparkSession, sf: str) -> DataFrame:
    parents = _read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("users_id")
    )
    result = delete.delete_group(
        _read(spark, sf, "lineitem"),
        _requests(spark, sf, "l_orderkey"),
        parents,
        "l_orderkey",
        "o_orderkey",
        "users_id",
    )
    kept = result.after.groupBy("l_orderkey").count()
    return result.status.select(
        F.lit("request").alias("kind"), F.col("request_id").alias("id"), "status", "rows"
    ).unionByName(
        kept.select(
            F.lit("kept").alias("kind"),
            F.col("l_orderkey").alias("id"),
            F.lit("").alias("status"),
            F.col("count").alias("rows"),
        )
    )


_REFERENCES = [
    delete.Reference("orders", "o_custkey", "customer", "c_custkey"),
    delete.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
]


def _registry(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: _read(spark, sf, t) for t in ("customer", "orders", "lineitem")}


def _sizes(held: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, df in held.items():
        size = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        rows = size if rows is None else rows.unionByName(size)
    return rows


def truncate_cascade(spark: SparkSession, sf: str) -> DataFrame:
    result = delete.truncate(_registry(spark, sf), "orders", _REFERENCES, refuse_empty=True)
    next_id = F.create_map(
        *[F.lit(v) for item in result.next_ids.items() for v in item]
    )
    return _sizes(result.tables).withColumns(
        {"status": F.lit(result.status), "next_id": F.try_element_at(next_id, F.col("name"))}
    )


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    held = _registry(spark, sf)
    # Every third customer and as many unknown ones.
    requests = held["customer"].select(
        F.col("c_custkey").alias("request_id"), (F.col("c_custkey") * 3).alias("c_custkey")
    )
    changes = delete.delete_cascade(held, _REFERENCES, "customer", requests, ["c_custkey"])
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}

    def side(name: str, rows: DataFrame, label: str) -> DataFrame:
        first, *more = keys[name]
        second = F.col(more[0]) if more else F.lit(0)
        return rows.select(
            F.lit(name).alias("name"),
            F.lit(label).alias("side"),
            F.col(first).cast("bigint").alias("key"),
            second.cast("bigint").alias("line"),
        )

    out = changes["customer"].status.select(
        F.lit("request").alias("name"),
        F.col("status").alias("side"),
        F.col("request_id").cast("bigint").alias("key"),
        F.lit(0).cast("bigint").alias("line"),
    )
    for name, change_of in changes.items():
        out = out.unionByName(side(name, change_of.after, "after"))
        out = out.unionByName(side(name, change_of.affected, "affected"))
    return out


def delete_cascade_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand below other parts and below suppliers, suppliers below parts."""
    key, supplier = F.col("p_partkey"), _read(spark, sf, "supplier")
    n = supplier.agg(F.count(F.lit(1))).scalar()
    held = {
        "part": _read(spark, sf, "part").select(
            key.alias("id"),
            F.when(key % 3 == 0, F.floor(key / 2)).when(key % 50 == 1, key).alias("part_of"),
            F.when(key % 5 == 0, key % n).alias("supplier"),
        ),
        "supplier": supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 7).alias("part")),
    }
    references = [
        delete.Reference("part", "part_of", "part", "id"),
        delete.Reference("part", "supplier", "supplier", "id"),
        delete.Reference("supplier", "part", "part", "id"),
    ]
    requests = held["part"].filter("id % 40 = 1").select(F.col("id").alias("request_id"), "id")
    changes = delete.delete_cascade(held, references, "part", requests, ["id"])
    out = None
    for name, change_of in changes.items():
        for side, rows in (("after", change_of.after), ("affected", change_of.affected)):
            part = rows.select(F.lit(name).alias("name"), F.lit(side).alias("side"), F.col("id").cast("bigint").alias("id"))
            out = part if out is None else out.unionByName(part)
    return out


def delete_restricted(spark: SparkSession, sf: str) -> DataFrame:
    requests = _read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.floor(F.col("event_id") * 3 / 2).alias("o_orderkey"),
    )
    result = delete.delete_restricted(
        _read(spark, sf, "orders"),
        requests,
        "o_orderkey",
        _read(spark, sf, "lineitem"),
        "l_orderkey",
    )
    return _statuses_and_rows(result.status, result.after, "o_orderkey")


def insert_unique(spark: SparkSession, sf: str) -> DataFrame:
    target = (
        _doubled(_read(spark, sf, "customer"), "c_custkey")
        .select(
            F.col("c_custkey").alias("id"), _customer_name("c_custkey").alias("nip"), "c_mktsegment"
        )
    )
    nip = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(
        _customer_name("o_custkey")
    )
    staged = _read(spark, sf, "orders").select("o_orderkey", nip.alias("nip"))
    result = change.insert_unique(target, staged, ["nip"], "o_orderkey")
    keyed = change.assign_keys(
        result.affected, "id", change.next_key(target, "id"), order_by=["o_orderkey"]
    )
    refused = result.status.filter(F.col("reason").isNotNull())
    no_id = F.lit(None).cast("bigint").alias("id")
    return refused.select("o_orderkey", "nip", "reason", no_id).unionByName(
        keyed.select("o_orderkey", "nip", F.lit("").alias("reason"), "id")
    )


def insert_defaults(spark: SparkSession, sf: str) -> DataFrame:
    target = _read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("nama"),
        F.col("p_brand").alias("peran"),
    )
    status = F.col("o_orderstatus")
    rows = _read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("nama"),
        F.when(status == "F", F.lit("")).when(status == "O", status).alias("peran"),
    )
    return change.append(target, rows, defaults={"peran": "peserta"}).after


def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    target = _read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("role"),
        F.lit(datetime.datetime(2024, 1, 1)).alias("updated_at"),
    )
    status = F.col("o_orderstatus")
    role = F.when(status == "F", F.lit("")).when(status == "O", F.col("o_orderpriority"))
    changes = _read(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("id"),
        role.alias("role"),
        F.col("o_orderkey").alias("seq"),
    )
    result = change.update_by_key(
        target, changes, "id", ["role"], {"updated_at": NOW}, order_by="seq"
    )
    counts = result.status.groupBy("status").count()
    rows = result.after.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))
    return rows.unionByName(
        counts.select(
            (-F.col("count")).alias("id"),
            F.col("status").alias("role"),
            F.lit("status").alias("updated_at"),
        )
    )


def rename_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Ten customers each want the others' names and a few new ones, many times over."""
    key, turn = F.col("o_custkey"), F.col("o_orderkey")
    target = _read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nama_tim")
    )
    block = F.floor(key / 10)
    other = (block * 10 + turn % 7).cast("string")
    name = (
        F.when(turn % 11 == 0, F.lit(""))
        .when(turn % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(other, 9, "0")))
        .otherwise(F.concat_ws(" ", F.lit("Tim"), block.cast("string"), (turn % 40).cast("string")))
    )
    requests = _read(spark, sf, "orders").select(
        turn.alias("seq"), F.when(turn % 13 == 0, -key).otherwise(key).alias("id"), name.alias("nama_tim")
    )
    result = rename(target, requests, "id", "nama_tim", "seq")
    after = result.after.select(
        F.lit(None).cast("bigint").alias("seq"), "id", "nama_tim", F.lit("after").alias("status")
    )
    return result.status.select("seq", "id", "nama_tim", "status").unionByName(after)


def _faulty_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, list[validate.Rule]]:
    day = F.col("o_orderkey") % 11
    total = F.col("o_orderkey") % 17
    rows = _read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(day == 0, F.lit("")).when(day != 1, F.col("o_orderpriority")).alias("nama"),
        F.when(day == 2, F.lit("x")).otherwise(total.cast("string")).alias("total_peserta"),
        F.lit("14abc").alias("sasaran_peserta"),
        F.when(day == 3, F.lit("boss")).when(day == 4, F.lit("admin")).alias("role"),
        F.col("o_custkey").alias("users_id"),
    )
    users = _doubled(_read(spark, sf, "customer"), "c_custkey")
    rules = [
        *validate.required("nama"),
        validate.not_greater("total_peserta", "sasaran_peserta"),
        validate.is_int("total_peserta"),
        validate.one_of("role", ["admin", "user"]),
        validate.exists_in("users_id", users, "c_custkey"),
    ]
    return rows, rules


def validate_good(spark: SparkSession, sf: str) -> DataFrame:
    rows, rules = _faulty_orders(spark, sf)
    return validate.validate_rows(rows, rules).good


def validate_bad(spark: SparkSession, sf: str) -> DataFrame:
    rows, rules = _faulty_orders(spark, sf)
    bad = validate.validate_rows(rows, rules).bad
    return bad.select("id", "users_id", F.array_join("errors", "; ").alias("errors"))


# --- export --------------------------------------------------------------


def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    parts = split.split_parts(_read(spark, sf, "lineitem"), LINE_ORDER, scanned=True)
    return split.part_manifest(parts, "lines", key="l_orderkey")


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents").select("doc_id", "lang")
    return split.split_parts(documents, [("lang", "desc"), "doc_id"], 64, scanned=True)


def split_files(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "parts")
    part = _read(spark, sf, "part").select("p_partkey", "p_name")
    split.write_parts(split.split_parts(part, ["p_partkey"], 300, scanned=True), path, "parts")
    schema = "p_partkey bigint, p_name string, name string"
    return spark.read.option("header", True).schema(schema).csv(path)


def split_source(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a CSV file in source order."""
    path = stage_path(spark, "source-csv")
    orders = _read(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey")
    orders.write.option("header", True).csv(path)
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint")
    loaded = csv.load_positional(spark, path, schema, spanning=False)
    return split.split_parts(loaded)


def split_source_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a CSV file with line breaks in quotes, read whole and in pieces."""
    path = stage_path(spark, "lines-csv")
    nick = F.concat(F.lit('a "b", '), "c_mktsegment", F.lit("\n"), F.col("c_nationkey").cast("string"))
    customer = _read(spark, sf, "customer").select("c_custkey", nick.alias("nick"))
    ordered = customer.orderBy("c_custkey")
    ordered.write.option("header", True).option("escape", '"').csv(path)

    def parts(bound: int | None, label: str) -> DataFrame:
        rows = registry.csv_parts(spark, path, 100, one_task_bytes=bound)
        return rows.withColumn("read", F.lit(label))

    return parts(None, "whole").unionByName(parts(0, "pieces"))


def load_participants(spark: SparkSession, sf: str) -> DataFrame:
    """New rows have the next ids in the order of the file."""
    path = stage_path(spark, "participants-csv")
    part = _read(spark, sf, "part").orderBy("p_partkey")
    part.select(
        F.concat(F.lit(" "), "p_name", F.lit("\n ")).alias("NAMA"), F.col("p_brand").alias("Instansi")
    ).write.option("header", True).option("escape", '"').csv(path)
    target = _read(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2).alias("peserta_id"),
        F.lit(3).alias("kegiatan_id"),
        F.col("s_name").alias("nama"),
        *[F.lit("").alias(c) for c in ("kabupaten", "instansi", "jabatan", "alamat", "jenjang", "peran")],
    )
    loaded = registry.load_participants(spark, path, target, 9)
    return loaded.after.select("peserta_id", "kegiatan_id", "nama", "instansi")


def load_activities(spark: SparkSession, sf: str) -> DataFrame:
    """New rows have the next ids in the order of the file."""
    path = stage_path(spark, "activities-csv")
    text = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))
    given = {
        "nama_kegiatan": F.col("o_orderpriority"),
        "tanggal_mulai": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "total_peserta": text,
    }
    orders = _read(spark, sf, "orders").orderBy("o_orderkey")
    orders.select(
        *[given.get(c, F.lit(None).cast("string")).alias(c) for c in tables.ACTIVITY_STAGED]
    ).write.option("header", True).csv(path)
    schema = T.StructType.fromDDL(tables.ACTIVITIES)
    known = _read(spark, sf, "customer").select(
        *[
            (F.col("c_custkey") + 5 if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    loaded = registry.load_activities(spark, path, known, 4, NOW)
    return loaded.after.select("id", "users_id", "nama_kegiatan", "tanggal_mulai", "total_peserta")


def page_500(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 491 to 500 of a wide table."""
    orders = _read(spark, sf, "orders").withColumn("o_orderdate", _day("o_orderdate"))
    return listing.page(orders, [("o_orderdate", "desc")], "o_orderkey", 50, 10).rows


def page_5000(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 4,991 to 5,000 of a wide table."""
    lines = _read(spark, sf, "lineitem").withColumn("l_shipdate", _day("l_shipdate"))
    order = [("l_shipdate", "desc"), *LINE_ORDER[2:6]]
    return listing.page(lines, order, LINE_ORDER, 500, 10).rows


def page_far(spark: SparkSession, sf: str) -> DataFrame:
    """A page so far on that the order is split over tasks."""
    lines = _read(spark, sf, "lineitem").withColumn("l_shipdate", _day("l_shipdate"))
    order = [("l_shipdate", "desc"), *LINE_ORDER[2:6]]
    return listing.page(lines, order, LINE_ORDER, 250, 100).rows


def rank_hot_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks in groups that are taken as too large for one task."""
    lines = _read(spark, sf, "lineitem").select("l_returnflag", *LINE_ORDER[:2])
    order = [F.col("l_orderkey").desc(), F.col("l_linenumber").asc()]
    return rank_in_group(lines, ["l_returnflag"], order, unique=True, large=100)


def clear_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each table after each of the four clears."""
    held = {
        "ptk": _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
        "data_sekolah": _read(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
        "ppg": _read(spark, sf, "part").select(F.col("p_partkey").alias("id")).filter("id < 0"),
        "kegiatan": _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")),
        "peserta": _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")),
    }
    clears = {
        "staff": registry.clear_staff,
        "schools": registry.clear_schools,
        "candidates": registry.clear_candidates,
        "activities": registry.clear_activities,
    }
    out = None
    for label, clear in clears.items():
        result = clear(held)
        rows = _sizes(result.tables).withColumns(
            {"clear": F.lit(label), "status": F.lit(result.status)}
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def create_users(spark: SparkSession, sf: str) -> DataFrame:
    users = _read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("nip"),
        F.lit("old").alias("nama"),
        F.lit("h").alias("password"),
        F.lit("user").alias("role"),
        F.lit(NOW).alias("created_at"),
        F.lit(NOW).alias("updated_at"),
    )
    code = F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))
    role = F.when(F.col("p_size") == 7, F.lit("boss")).when(F.col("p_size") == 8, F.lit(""))
    number = F.floor(F.col("p_partkey") / 3).cast("string")
    supplier = F.concat(F.lit("Supplier#"), F.lpad(number, 9, "0"))
    requests = _read(spark, sf, "part").select(
        F.col("p_partkey").alias("request_id"),
        supplier.alias("nip"),
        F.col("p_name").alias("nama"),
        F.lit("h").alias("password"),
        role.alias("role"),
        F.array(F.lit("unknown"), code, code).alias("codes"),
    )
    permissions = _permissions(spark, sf)
    no_links = _links(spark, sf).limit(0)
    added, links = registry.create_users(users, no_links, permissions, requests, NOW)
    made = added.affected.select("id", "nip", "nama", "role", F.lit("").alias("reason"))
    granted = links.select(
        F.col("user_id").alias("id"),
        F.col("permission_id").cast("string").alias("nip"),
        F.lit("link").alias("nama"),
        F.lit("").alias("role"),
        F.lit("").alias("reason"),
    )
    refused = added.status.filter(F.col("reason").isNotNull()).select(
        F.col("request_id").alias("id"),
        F.lit("").alias("nip"),
        F.lit("refused").alias("nama"),
        F.lit("").alias("role"),
        "reason",
    )
    return made.unionByName(granted).unionByName(refused)


def update_users(spark: SparkSession, sf: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    users = _users(spark, sf).select(
        "id", F.lit("user").alias("role"), F.lit(None).cast("timestamp").alias("updated_at")
    )
    role = (
        F.when(nation % 5 == 0, F.lit("boss"))
        .when(nation % 5 == 1, F.lit(""))
        .when(nation % 5 == 2, F.lit("admin"))
    )
    ids = F.when(nation % 3 == 0, F.array(key, key)).when(nation % 3 == 1, F.array(key, key + 1))
    requests = _read(spark, sf, "customer").select(
        key.alias("request_id"), F.floor(key / 4).alias("id"), role.alias("role"), ids.alias("ids")
    )
    changed, sets = registry.update_users(users, _links(spark, sf), requests, NOW)
    roles = changed.after.select(
        F.lit("user").alias("kind"),
        "id",
        F.col("role").alias("text"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("more"),
    )
    statuses = changed.status.select(
        F.lit("request").alias("kind"),
        F.col("request_id").alias("id"),
        F.col("status").alias("text"),
        F.lit("").alias("more"),
    )
    links = sets.after.select(
        F.lit("link").alias("kind"),
        F.col("user_id").alias("id"),
        F.col("permission_id").cast("string").alias("text"),
        F.lit("").alias("more"),
    )
    return roles.unionByName(statuses).unionByName(links)


def search_candidates(spark: SparkSession, sf: str) -> DataFrame:
    candidates = _read(spark, sf, "part").select(
        F.col("p_partkey").alias("no_ukg"),
        F.col("p_size").alias("tahun"),
        F.col("p_name").alias("nama_lengkap"),
    )
    cut = registry.search_candidates(candidates, keyword="", query=" Ring\t", page="2", limit="x")
    return cut.with_totals()


def single_value(spark: SparkSession, sf: str) -> DataFrame:
    """Of whole tables whose column holds one value, or none."""
    documents = _read(spark, sf, "documents")
    same = documents.select(F.concat(F.lit("v"), F.col("n_chars") * 0).alias("isi"))
    none = documents.select(F.nullif("n_chars", "n_chars").cast("string").alias("isi"))
    return listing.single_value(same, "isi").unionByName(listing.single_value(none, "isi", "-"))


def update_all(spark: SparkSession, sf: str) -> DataFrame:
    documents = _read(spark, sf, "documents").select("doc_id", "lang", "text")
    return change.update_all(documents, {"text": "isi"}).after


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        page_list,
        page_envelope,
        user_list,
        search_multi,
        search_page,
        search_pattern,
        search_documents,
        search_requests,
        page_lookups,
        search_lookups,
        all_lookups,
        totals_base_joined,
        by_key_set,
        by_key_text,
        children_page,
        children_pages,
        children_pages_long,
        cast_order_blank,
        all_pages,
        distribution,
        cross_distribution,
        statistics_feed,
        codes_per_user,
        codes_of_one_user,
        codes_of_requested,
        codes_in_rows,
        permission_codes,
        has_access,
        replace_set,
        assign_codes,
        dedupe_by_key,
        upsert,
        upsert_large,
        normalise_dates,
        normalise_ints,
        append_normalised,
        csv_positional,
        csv_by_name,
        csv_mixed,
        csv_unclosed,
        header_rules,
        publish_snapshot,
        merge_ranges,
        ingest_dir,
        delete_by_key,
        delete_owned,
        delete_scoped,
        delete_group,
        truncate_cascade,
        delete_cascade,
        delete_cascade_cycle,
        delete_restricted,
        insert_unique,
        insert_defaults,
        update_by_key,
        rename_unique,
        create_users,
        update_users,
        update_all,
        search_candidates,
        single_value,
        validate_good,
        validate_bad,
        split_manifest,
        split_rows,
        split_files,
        split_source,
        split_source_lines,
        load_participants,
        load_activities,
        page_500,
        page_5000,
        page_far,
        rank_hot_groups,
        clear_tables,
    )
}
