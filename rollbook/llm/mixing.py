"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Each cell's tokens get
a weight; the weights are raked until the weighted tokens of every source, every
language and every topic have their target shares. A sample can't hold more of a value than there
is, so probabilities are raked by themselves (``fitted``), never above 1: the expected
tokens are the asked share of all, and each value's share of them is its target, or all its tokens
where that is less, the others' targets then being scaled up alike. DataFrame functions only.

Without given targets a dimension's shares are tempered: tokens to the power
``TEMPER``, scaled to 1. Given shares are scaled to 1 over the values that
occur; a value without a share has none of its documents sampled. Targets that no weights can reach are met
as nearly as the last round does.

The topic is the form of a text (``form``), unless a column is given. Null sources,
languages and topics are the empty value. Null and empty texts have 0 tokens and
the weight of their cell; where a cell has no tokens, its weight stays 1 times the
factors of its values. A row is sampled by a hash of its ``doc_id``, so rows
that share an id are sampled alike if they lie in one cell. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.tables import stage
from rollbook.plans.sizing import hint_by_size

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.5
ROUNDS = 12
#: Share of all tokens that a sample is expected to have.
SHARE = 0.75
SEED = "mix"
#: Rounds to find the documents that are sampled surely.
CAP_ROUNDS = 12

_MARKS = ("|", "!!", "#", "$")


def n_tokens(text: Column) -> Column:
    """Words of a text, runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def form(text: Column, tokens: Column) -> Column:
    """A text's form: ``table``, ``shout`` or ``marked`` if a fifth of its words carry such marks, else by length."""
    text = F.coalesce(text, F.lit(""))
    bar, loud, hash_, dollar = (_occurrences(text, m) for m in _MARKS)
    return (
        F.when(5 * bar >= F.greatest(tokens, F.lit(5)), "table")
        .when(5 * loud >= F.greatest(tokens, F.lit(5)), "shout")
        .when(5 * (hash_ + dollar) >= F.greatest(tokens, F.lit(5)), "marked")
        .when(tokens < 100, "short")
        .when(tokens < 1000, "middle")
        .otherwise("long")
    )


def in_cells(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """``docs`` with ``__source, __lang, __topic`` and ``__tokens``."""
    counted = docs.withColumn("__tokens", n_tokens(docs["text"]))
    named = form(F.col("text"), F.col("__tokens")) if topic is None else F.col(f"`{topic}`").cast("string")
    return counted.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "__topic": F.coalesce(named, F.lit("")),
    })


def _targets(cells: DataFrame, dimension: str, given: Mapping[str, float] | None, temper: float) -> DataFrame:
    """``value, share`` of each value that occurs."""
    values = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    if given is None:
        raw = values.withColumn("raw", F.pow("tokens", F.lit(temper)))
    else:
        share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in given.items() for x in kv)), F.col("value")), F.lit(0.0))
        raw = values.withColumn("raw", share.cast("double"))
    total = raw.agg(F.sum("raw")).first()[0] or 0.0
    return raw.select("value", (F.col("raw") / F.lit(float(total)) if total else F.lit(0.0)).alias("share"))


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (``source, lang, topic, tokens``) with a ``weight`` for their tokens.

    One short row per cell: a round sums them by each dimension in turn and is written.
    """
    cells = stage(cells, "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    current = cells.withColumn("weight", F.lit(1.0))
    for d in DIMENSIONS:
        share = _targets(cells, d, (targets or {}).get(d), temper)
        current = current.join(share.select(F.col("value").alias(d), F.col("share").alias(f"share_{d}")), d)
    current = stage(current, "raked")
    for _ in range(rounds):
        for d in DIMENSIONS:
            has = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(d))
            factor = F.when(has > 0, F.col(f"share_{d}") * F.lit(total) / has).otherwise(1.0)
            current = current.withColumn("weight", F.col("weight") * factor)
        current = stage(current, "raked")
    return current.select(*DIMENSIONS, "tokens", "weight")


def sampling_factor(cells: DataFrame, share: float) -> float:
    """f such that the sum of ``tokens * min(1, f * weight)`` is ``share`` of all tokens.

    Cells that reach 1 are set apart until no more do.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    factor = 0.0
    for _ in range(CAP_ROUNDS):
        sure = F.col("weight") * factor >= 1
        row = cells.agg(
            F.sum(F.when(sure, F.col("tokens")).otherwise(0)).alias("sure"),
            F.sum(F.when(sure, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("rest"),
        ).first()
        if not row["rest"]:
            break
        new = (share * total - row["sure"]) / row["rest"]
        if new <= factor:
            break
        factor = new
    return factor


def fitted(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with a ``probability``, raked as ``raked`` does but never above 1.

    A value's goal is its target or, where it has fewer tokens, all of them; the
    others' goals grow alike, so that each dimension's add up to ``share`` of all tokens.
    """
    cells = stage(cells, "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    current = cells.withColumn("probability", F.lit(float(share)))
    for d in DIMENSIONS:
        values = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"))
        values = values.join(_targets(cells, d, (targets or {}).get(d), temper), "value")
        values = stage(values.withColumn("weight", F.when(F.col("tokens") > 0, F.col("share") * F.lit(total) / F.col("tokens")).otherwise(0.0)), "goals")
        goal = F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(sampling_factor(values, share)))
        current = current.join(values.select(F.col("value").alias(d), goal.alias(f"goal_{d}")), d)
    current = stage(current, "fitted")
    for _ in range(rounds):
        for d in DIMENSIONS:
            has = F.sum(F.col("tokens") * F.col("probability")).over(Window.partitionBy(d))
            factor = F.when(has > 0, F.col(f"goal_{d}") / has).otherwise(1.0)
            current = current.withColumn("probability", F.least(F.lit(1.0), F.col("probability") * factor))
        current = stage(current, "fitted")
    # Rounds that end early or goals that exclude each other may miss the share of all tokens by a little.
    last = sampling_factor(current.select("tokens", F.col("probability").alias("weight")), share)
    return current.withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.lit(last))).select(*cells.columns, "probability")


def _cells(placed: DataFrame) -> DataFrame:
    return placed.groupBy(*(F.col(f"__{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("__tokens").alias("tokens"))


def _drawn(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """``placed`` with the columns of its cells, and ``__kept`` by their ``probability``."""
    small = hint_by_size(cells)
    of_cell = small(cells.drop("tokens").toDF(*(f"__{c}" for c in cells.columns if c != "tokens")))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return placed.join(of_cell, [f"__{d}" for d in DIMENSIONS]).withColumn("__kept", uniform < F.col("__probability"))


def weighted(docs: DataFrame, topic: str | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE) -> DataFrame:
    """``docs`` with ``__source, __lang, __topic, __tokens, __weight, __probability`` and ``__kept``."""
    placed = in_cells(docs, topic)
    return _drawn(placed, fitted(raked(_cells(placed), targets), targets, share=share))


def mixed(docs: DataFrame) -> DataFrame:
    """Each document's cell, tokens, raked weight, calibrated probability and whether it is sampled."""
    return weighted(docs.select("doc_id", "text", "source", "lang")).select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"), F.col("__kept").alias("kept"),
    )


def sampled(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The sampled rows of ``docs``, with their columns."""
    placed = in_cells(docs)
    return _drawn(placed, fitted(_cells(placed), share=share)).where("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    """The rows of ``mixed`` in DuckDB's SQL, rounds written out."""
    n = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    marks = {m: f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}.0" for m in _MARKS}
    parts = [
        f"placed as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, coalesce(text, '') t, {n} tokens from documents)",
        f"""formed as (select doc_id, source, lang, tokens, case
            when 5 * {marks["|"]} >= greatest(tokens, 5) then 'table' when 5 * {marks["!!"]} >= greatest(tokens, 5) then 'shout'
            when 5 * ({marks["#"]} + {marks["$"]}) >= greatest(tokens, 5) then 'marked'
            when tokens < 100 then 'short' when tokens < 1000 then 'middle' else 'long' end topic from placed)""",
        "cells as materialized (select source, lang, topic, sum(tokens)::double tokens from formed group by all)",
    ]
    for d in DIMENSIONS:
        parts.append(f"share_{d} as materialized (select {d}, raw / sum(raw) over () share from (select {d}, pow(sum(tokens), {TEMPER}) raw from cells group by 1))")
    parts.append("r0 as (select *, 1.0::double weight from cells)")
    at = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(
                f"r{at + 1} as materialized (select source, lang, topic, tokens, weight * case when has > 0 then share * (select sum(tokens) from cells) / has else 1 end weight"
                f" from (select *, sum(tokens * weight) over (partition by {d}) has from r{at}) join share_{d} using ({d}))"
            )
            at += 1

    def factor(name: str, rows: str) -> str:
        """CTEs that find the factor of ``sampling_factor`` for ``rows``; the name of the last."""
        parts.append(f"{name}0 as (select 0.0::double f)")
        for i in range(CAP_ROUNDS):
            parts.append(
                f"{name}{i + 1} as materialized (select greatest(any_value(f), coalesce(({SHARE} * sum(tokens) - sum(case when weight * f >= 1 then tokens else 0 end))"
                f" / nullif(sum(case when weight * f >= 1 then 0 else tokens * weight end), 0), 0)) f from {rows}, {name}{i})"
            )
        return f"{name}{CAP_ROUNDS}"

    # Probabilities: goals of each value, then rounds in which none exceeds 1.
    for d in DIMENSIONS:
        parts.append(
            f"values_{d} as materialized (select {d}, tokens, case when tokens > 0 then share * (select sum(tokens) from cells) / tokens else 0 end weight"
            f" from (select {d}, sum(tokens) tokens from cells group by 1) join share_{d} using ({d}))"
        )
        last = factor(f"f_{d}_", f"values_{d}")
        parts.append(f"goal_{d} as materialized (select {d}, tokens * least(1.0, weight * f) goal from values_{d}, {last})")
    parts.append(f"p0 as (select source, lang, topic, tokens, {SHARE}::double weight from cells)")
    rounds = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(
                f"p{rounds + 1} as materialized (select source, lang, topic, tokens, least(1.0, weight * case when has > 0 then goal / has else 1 end) weight"
                f" from (select *, sum(tokens * weight) over (partition by {d}) has from p{rounds}) join goal_{d} using ({d}))"
            )
            rounds += 1
    last = factor("f", f"p{rounds}")
    parts.append(f"fitted as materialized (select source, lang, topic, least(1.0, weight * f) probability from p{rounds}, {last})")
    return (
        "with " + ",\n".join(parts) + f"""
        select doc_id, source, lang, topic, formed.tokens as n_tokens, round(weight, 6) weight, round(probability, 6) probability,
            ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < probability kept
        from formed join r{at} using (source, lang, topic) join fitted using (source, lang, topic)"""
    )
