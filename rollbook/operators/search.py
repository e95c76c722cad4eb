"""Searches by a table of search texts, without comparing each text with each row.

A pattern matches only rows that hold every run of characters between its wildcards. So each pattern is looked up
by one of its grams (three characters, fewer if it has no longer run), the one
that the fewest rows hold, in the postings of the grams that are asked for; what is found is
verified with the whole pattern. A pattern without any character of its own, such as '%', is
looked up by the empty gram, which all rows hold. Tasks look through blocks of texts for the grams asked for
(``functions.grams``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import grams as gram_finder
from rollbook.functions.predicates import MODES
from rollbook.functions.text import JS_WHITESPACE
from rollbook.plans import hint_by_size, stage

cloudpickle.register_pickle_by_value(gram_finder)

REQUEST = "request_id"
_GRAM = 3


def pattern_column(q: Column, mode: str = "contains", literal: bool = False) -> Column:
    """``ilike_pattern`` of a column of search texts."""
    if mode not in MODES:
        raise ValueError(f"unknown search mode {mode!r}; use one of {MODES}")
    if literal:
        q = F.regexp_replace(q, r"([\\%_])", r"\\$1")
    whole = F.concat(F.lit("%"), q, F.lit("%")) if mode == "contains" else q
    # A backslash and what follows are read together, from the left; it stays before a wildcard or another.
    pattern = F.regexp_replace(whole, r"(?s)(\\[%_\\])|\\(.)", "$1$2")
    lone = whole.rlike(r"(?s)^(?:[^\\]|\\.)*\\$")
    return F.when(lone, F.raise_error(F.lit("an exact search text must not end with a backslash"))).otherwise(pattern)


def search_batch(
    df: DataFrame,
    requests: DataFrame,
    terms: Sequence[tuple[str, str]],
    key: str,
    text: str = "q",
    trim: bool = False,
    literal: bool = False,
) -> DataFrame:
    """``request_id`` and ``key`` of each row of ``df`` that a request's ``text`` is found in, each pair once.

    A row is found if any ``(column, mode)`` term matches, as in ``predicates.search``; a null
    text finds nothing. ``key`` is unique in ``df`` and ``request_id`` in ``requests``. Equal texts are looked up once.
    """
    q = F.col(text)
    if trim:
        q = F.btrim(q, F.lit(JS_WHITESPACE))
    asked = requests.select(REQUEST, q.alias("_q")).filter(F.col("_q").isNotNull())
    texts = asked.select("_q").distinct()
    found = [_found(df, texts, column, mode, key, literal) for column, mode in terms]
    pairs = reduce(DataFrame.unionByName, found).distinct()
    return asked.join(pairs, "_q").select(REQUEST, key)


def _found(df: DataFrame, texts: DataFrame, column: str, mode: str, key: str, literal: bool) -> DataFrame:
    """``_q`` and ``key`` of the rows whose ``column`` matches."""
    patterns = stage(texts.withColumn("_pattern", pattern_column(F.col("_q"), mode, literal)), "patterns")
    runs = _runs_of(F.col("_pattern"))
    wanted = stage(patterns.select("_q", "_pattern", runs.alias("_runs"), F.explode(_grams_of(runs)).alias("_gram")), "grams")
    grams = wanted.select("_gram").distinct()
    sizes = [r[0] for r in grams.select(F.length("_gram")).distinct().collect()]  # of 0 to 3
    rows = df.select(F.col(key).alias("_key"), F.lower(F.col(column)).alias("_text")).filter(F.col("_text").isNotNull())
    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("_gram", T.StringType())])
    posted = rows.mapInArrow(gram_finder.finder(_bitmaps(grams), sizes), schema)
    # Bits may be shared with other grams.
    posted = stage(posted.join(hint_by_size(grams)(grams), "_gram", "left_semi"), "postings")
    counts = posted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # Grams that no row holds rule their patterns out.
    rated = wanted.join(counts, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    best = rated.groupBy("_q", "_pattern", "_runs").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    # Patterns travel to the postings, which are many however small they are written.
    hint = hint_by_size(wanted)
    # Where the gram is all that a pattern asks for, its postings are the rows found.
    run = F.coalesce(F.length(F.get("_runs", F.lit(0))), F.lit(0))
    sure = _open_ended(F.col("_pattern")) & (F.size("_runs") <= 1) & (run <= _GRAM)
    at_once = posted.join(hint(best.filter(sure)), "_gram").select("_q", "_key")
    pairs = posted.join(hint(best.filter(~sure)), "_gram").select("_key", "_q", "_pattern", "_runs")
    # Comparing is the costly part, so pairs are dealt to all tasks whatever their size in bytes.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checked = pairs.repartition(tasks, "_key").join(rows, "_key").filter(_verified(F.col("_text"), F.col("_pattern"), F.col("_runs")))
    return at_once.unionByName(checked.select("_q", "_key")).withColumnRenamed("_key", key)


def _bitmaps(grams: DataFrame) -> dict[int, bytes]:
    """Spark's bitmaps of the buckets of all grams: 128 KB in all, whatever their number."""
    numbers = grams.mapInArrow(gram_finder.buckets, "bucket long")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("bucket")).alias("bits")
    parts = numbers.groupBy(F.bitmap_bucket_number("bucket").alias("part")).agg(bits)
    return {r["part"]: bytes(r["bits"]) for r in parts.collect()}


def _open_ended(pattern: Column) -> Column:
    """Whether a pattern has no wildcard but percent signs, and one at either end."""
    return pattern.rlike(r"^%([^_\\]*%)?$")


def _verified(text: Column, pattern: Column, runs: Column) -> Column:
    """Whether a text matches: runs between percent signs in their order, any other pattern by LIKE."""
    behind = F.aggregate(
        runs, F.lit(1), lambda at, run: F.when(at > 0, _after(text, run, at)).otherwise(F.lit(0))
    )
    all_held = F.forall(runs, lambda run: F.contains(text, run))
    return F.when(_open_ended(pattern), behind > 0).otherwise(all_held & F.call_function("like", text, F.lower(pattern)))


def _after(text: Column, run: Column, at: Column) -> Column:
    """The place behind the first ``run`` from ``at`` on, 0 if there is none."""
    found = F.call_function("locate", run, text, at)
    return F.when(found > 0, found + F.length(run)).otherwise(F.lit(0))


def _runs_of(pattern: Column) -> Column:
    """The characters between the wildcards of a pattern, lower case; an escaped one ends its run, too."""
    # Wildcards become a separator that no text in use holds; escaped ones stand for themselves.
    marked = F.regexp_replace(F.lower(pattern), r"(?s)\\(.)|[%_]", "\uffff$1\ufffe")
    plain = F.regexp_replace(marked, "\uffff\ufffe", "\ufffe")
    return F.filter(F.split(F.regexp_replace(plain, "[\uffff\ufffe]", "\ufffe"), "\ufffe"), lambda r: r != "")


def _grams_of(runs: Column) -> Column:
    """The grams of a pattern's runs, all of the greatest size there is."""
    longest = F.least(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), F.lit(_GRAM))

    def grams(n: int) -> Column:
        return F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams_in(r, n))))

    out = F.array(F.lit(""))
    for n in range(1, _GRAM + 1):
        out = F.when(longest == n, grams(n)).otherwise(out)
    return out


def _grams_in(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a short text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.filter(F.transform(starts, lambda at: F.substr(text, at, F.lit(size))), lambda g: F.length(g) == size)
