"""Secret scans: candidates by pattern, told apart by who holds them in the whole corpus.

Three base patterns (``assign``, ``access``, ``hex``) and one wide pattern (``key``: long mixed
runs, signed tokens, passwords in addresses) give candidates. Every candidate's
value is hashed and counted over the corpus by the distinct repositories and
owners that hold it: a value that more than ``max_owners`` owners hold is a widely
copied example, one that a few hold is their own. Base spans always stay; a ``key`` span is added if its
value looks live, is owner-specific and touches no base span.

An owner is a document's ``source`` and a repository its ``doc_id`` unless other columns are
given; null ones are one owner and one repository of their own, named ''. Null and empty texts have no
spans. Rows are handled one by one, also if an id or a whole row is repeated. Other columns are ignored.
Positions are code points, ends exclusive. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.tables import stage
from rollbook.plans.sizing import hint_by_size

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "key")
KEY = KINDS.index("key")

#: A value held by more owners than this is a copied example.
MAX_OWNERS = 2

_WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 6
# Runs that are too short are no match here; as they are whole runs, nothing else can match inside them.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_SIGNED = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_ADDRESS = r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"
_RUN = r"[A-Za-z0-9_-]{20,}"
KEYS = f"{_SIGNED}|{_ADDRESS}|{_RUN}"

#: Words and runs that stand in documentation instead of a value.
PLACEHOLDER = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Xx]{4}|0{6}|123456|\*{3}"
VENDOR = r"^(ghp_|gho_|github_pat_|glpat-|sk_live_|rk_live_|xox[abp]-|AIza|npm_|eyJ)"

# Starts inside a run fail as the run's own start does; looking behind spares them.
_FAST = {HEX: rf"(?<![0-9a-f]){HEX}", KEYS: f"{_SIGNED}|{_ADDRESS}|(?<![A-Za-z0-9_-]){_RUN}"}

_HIT = "struct<kind:int,gap:int,width:int,value:bigint,sound:boolean,live:boolean>"


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def looks_live(value: Column) -> Column:
    """Whether a ``key`` value looks generated: a vendor's prefix, mixed cases and digits, or upper-case hex."""
    mixed = (_count(value, "0-9") >= 3) & (_count(value, "a-z") >= 3) & (_count(value, "A-Z") >= 3)
    hexed = value.rlike("^[0-9A-F]{24,}$") & (_count(value, "0-9") >= 6)
    return (value.rlike(VENDOR) | mixed | hexed) & ~value.rlike(PLACEHOLDER)


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """The matches of one kind, in order: characters since the last match, own characters, hash of the value."""
    fast = _FAST.get(pattern, pattern)
    # A text is cut at its matches: n matches and n + 1 pieces between them.
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(fast), F.lit(0)), F.split(text, fast, -1))

    def hit(pair: Column) -> Column:
        match, gap = pair.getField("0"), pair.getField("1")
        if kind == "assign":
            value = F.regexp_extract(match, ASSIGN, 2)
            sound, live = F.length(value) >= MIN_ASSIGNED, ~value.rlike(PLACEHOLDER)
        elif kind == "key":
            secret = F.regexp_extract(match, ":([^:]+)@$", 1)
            value = F.when(match.startswith("://"), secret).otherwise(match)
            live = F.when(match.startswith("://"), ~secret.rlike(PLACEHOLDER)).otherwise(looks_live(match))
            sound = live
        else:
            value, sound, live = match, F.lit(True), ~match.rlike(PLACEHOLDER)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("width"),
            F.xxhash64(value).alias("value"), sound.alias("sound"), live.alias("live"),
        )

    found = F.filter(F.transform(pairs, hit), lambda h: h["width"].isNotNull())
    return F.when(text.rlike(fast), found).otherwise(F.array().cast(f"array<{_HIT}>"))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One written row per document: ``row, doc_id, owner, repository`` and its ``hits``; values only as hashes."""
    text = F.coalesce(F.col("`text`"), F.lit(""))

    def name(column: str) -> Column:
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))

    parts = [_hits(text, k, p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, KEYS), strict=True)]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").alias("doc_id"),
        name(owner).alias("owner"), name(repository).alias("repository"), F.concat(*parts).alias("hits"),
    )
    return stage(rows, "candidates")


def ownership(rows: DataFrame) -> DataFrame:
    """``value, owners, repositories`` of each candidate value of ``candidates``.

    Summed in three steps, so that a value which a third of all documents hold is
    spread over its repositories first and over its owners next.
    """
    held = rows.select("owner", "repository", F.explode("hits").alias("hit")).where("hit.sound")
    each = held.select(F.col("hit.value").alias("value"), "owner", "repository").distinct()
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def spans(rows: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``row, doc_id, kind, start, end, base, live`` of each span that counts; ``live`` ones look live and are owner-specific."""
    copied = stage(ownership(rows).where(F.col("owners") > max_owners).select("value", F.lit(True).alias("copied")), "copied")
    hits = rows.select("row", "doc_id", F.posexplode("hits").alias("nth", "hit")).select("row", "doc_id", "nth", "hit.*")
    hits = hits.join(hint_by_size(copied)(copied), "value", "left")
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("width")).over(so_far))
    placed = placed.where("sound").select(
        "row", "doc_id", "kind", (F.col("end") - F.col("width")).alias("start"), "end",
        (F.col("kind") != KEY).alias("base"), (F.col("live") & F.col("copied").isNull()).alias("live"),
    )
    by_row = Window.partitionBy("row")
    before = by_row.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = by_row.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumns({
        "from_left": F.max(F.when(F.col("base"), F.col("end"))).over(before),
        "from_right": F.min(F.when(F.col("base"), F.col("start"))).over(after),
    })
    free = (F.coalesce("from_left", F.lit(0)) <= F.col("start")) & (F.coalesce("from_right", F.col("end")) >= F.col("end"))
    return near.where(F.col("base") | (F.col("live") & free)).drop("from_left", "from_right")


def _listed(which: Column) -> Column:
    """``kind:start:end`` of the spans of a row, by start and kind; a row has as many as its own text."""
    found = F.array_sort(F.collect_list(F.when(which, F.struct("start", "kind", "end"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    texts = F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(texts, ",")


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, all ``spans`` as text, and how many are ``n_live`` and ``n_copied``.

    ``n_live`` spans look live and belong to few owners; the other spans (``n_copied``) are
    placeholders or widely copied. Documents without a candidate need no shuffle.
    """
    rows = candidates(docs, owner, repository)
    with_hits = rows.where(F.size("hits") > 0)
    found = spans(with_hits, max_owners)

    def number(which: Column) -> Column:
        return F.count(F.when(which, 1))

    per_row = found.groupBy("row").agg(
        *(number(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:KEY])),
        _listed(F.col("base")).alias("listed"), _listed(F.lit(True)).alias("spans"),
        number(F.col("live")).alias("n_live"), number(~F.col("live")).alias("n_copied"),
    )
    zero = F.lit(0).cast("long")
    numbers = [*(f"n_{k}" for k in KINDS[:KEY]), "n_live", "n_copied"]
    none = rows.where(F.size("hits") == 0).select("doc_id", *(zero.alias(c) for c in numbers), *(F.lit("").alias(c) for c in ("listed", "spans")))
    some = with_hits.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *(F.coalesce(c, zero).alias(c) for c in numbers), *(F.coalesce(c, F.lit("")).alias(c) for c in ("listed", "spans"))
    )
    every = none.unionByName(some).withColumn("base_sha256", F.sha2(F.col("listed").cast("binary"), 256))
    return every.select("doc_id", *(f"n_{k}" for k in KINDS[:KEY]), "base_sha256", "spans", "n_live", "n_copied")


def oracle_sql() -> str:
    """The rows of ``scanned`` over ``documents`` in DuckDB's SQL."""
    quoted = {k: p.replace("'", "''") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, KEYS), strict=True)}
    hits = " union all ".join(
        f"""select row, {i} kind, unnest(regexp_extract_all(t, '{p}')) hit, unnest(string_split_regex(t, '{p}')[:-2]) gap,
            unnest(range(1, len(string_split_regex(t, '{p}')))) nth from docs where regexp_matches(t, '{p}')"""
        for i, p in enumerate(quoted.values())
    )

    def count(chars: str) -> str:
        return f"length(regexp_replace(value, '[^{chars}]', '', 'g'))"

    place = f"not regexp_matches(value, '{PLACEHOLDER}')"
    live = f"""(regexp_matches(value, '{VENDOR}') or ({count("0-9")} >= 3 and {count("a-z")} >= 3 and {count("A-Z")} >= 3)
        or (regexp_matches(value, '^[0-9A-F]{{24,}}$') and {count("0-9")} >= 6)) and {place}"""
    name = "case kind " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
    listed = f"string_agg({name} || ':' || s || ':' || e, ',' order by s, kind)"
    counts = ", ".join(f"coalesce(n_{k}, 0)::bigint n_{k}" for k in KINDS[:KEY])
    return f"""with docs as (select row_number() over () as row, doc_id, coalesce(source, '') as owner, coalesce(text, '') t from documents),
        hits as ({hits}),
        valued as (select *, case when kind = 0 then regexp_extract(hit, '{quoted["assign"]}', 2)
            when kind = {KEY} and starts_with(hit, '://') then regexp_extract(hit, ':([^:]+)@$', 1) else hit end as value,
            sum(length(gap) + length(hit)) over (partition by row, kind order by nth) as e from hits),
        judged as (select row, kind, value, (e - length(hit))::bigint as s, e::bigint as e,
            case when kind = {KEY} and not starts_with(hit, '://') then {live} else {place} end as looks,
            case when kind = 0 then length(value) >= {MIN_ASSIGNED} when kind = {KEY} then looks else true end as sound from valued),
        held as (select value, count(distinct owner) as owners from judged join docs using (row) where sound group by value),
        sound as (select row, kind, s, e, looks and owners <= {MAX_OWNERS} as live from judged join held using (value) where sound),
        kept as (select * from sound a where kind <> {KEY} or (live and not exists
            (select 1 from sound b where b.row = a.row and b.kind <> {KEY} and b.s < a.e and b.e > a.s))),
        per_row as (select row, {", ".join(f"count(*) filter (kind = {i}) n_{k}" for i, k in enumerate(KINDS[:KEY]))},
            {listed} filter (kind <> {KEY}) as listed, {listed} as spans,
            count(*) filter (live) as n_live, count(*) filter (not live) as n_copied from kept group by row)
        select doc_id, {counts}, sha256(coalesce(listed, '')) as base_sha256, coalesce(spans, '') as spans,
            coalesce(n_live, 0)::bigint as n_live, coalesce(n_copied, 0)::bigint as n_copied
        from docs left join per_row using (row)"""
