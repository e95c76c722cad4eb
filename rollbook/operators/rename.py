"""Renames under a unique name, judged as if the requests were sent one by one.

Whether a request is accepted depends on earlier ones: a name may have been freed or taken
meanwhile. So decisions are guessed and improved in rounds, each over the whole
batch. Given a guess, a claim that is accepted holds its name until its owner's next accepted
request or next claim of the same name; the claims that hold a name in turn form a chain, each the first one
once the hold before it has ended. The claims on the chains are the next guess. The first
request is right from the start and every round settles at least the next open
one, in practice all but those that hang on a wrong guess; when nothing changes, the
decisions are those of the requests in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import is_given
from rollbook.operators.change import Change, update_by_key
from rollbook.plans import hint_by_size, largest_group, next_in_group, number_rows, stage
from rollbook.plans.ranking import LARGE_GROUP_ROWS

# Up to this many claims of a name are judged by a fold over them.
FOLDED_CLAIMS = 1_000


def rename_unique(
    target: DataFrame,
    requests: DataFrame,
    key: str,
    col: str,
    order_by: str,
    large: int = LARGE_GROUP_ROWS,
    folded: int = FOLDED_CLAIMS,
) -> Change:
    """Set ``col``, which is unique and required, by key, request by request.

    A request is ``updated`` if no other row has the name when its turn comes, else
    ``duplicate``; ``missing`` without a name and ``not_found`` without a row. Requests count in the order of
    ``order_by``, ties by key and name. Rounds are as many as decisions hang on
    each other, and each is written. A name or key with more than ``large`` requests is spread over tasks.
    """
    hint = hint_by_size(requests.select(key, col))
    known = target.join(hint(requests.select(key).distinct()), key, "left_semi").select(key, F.lit(True).alias("_known"))
    number = [F.col(c).asc_nulls_first() for c in (order_by, key, col)]
    asked = stage(number_rows(requests.join(known, key, "left"), number, "_turn"), "renames")
    usable = asked.filter(is_given(F.col(col)) & F.col("_known"))
    turns = usable.select("_turn", F.col(key).alias("_id"), F.col(col).alias("_name"))
    holders = target.join(hint(turns.select(F.col("_name").alias(col)).distinct()), col, "left_semi")
    holders = stage(holders.select(F.col(col).alias("_name"), F.col(key).alias("_holder")), "holders")
    accepted = _accepted(turns, holders, large, folded)
    status = (
        asked.join(hint(accepted.withColumn("_accepted", F.lit(True))), "_turn", "left")
        .withColumn(
            "status",
            F.when(~is_given(F.col(col)), "missing")
            .when(F.col("_known").isNull(), "not_found")
            .when(F.col("_accepted"), "updated")
            .otherwise("duplicate"),
        )
        .select(*requests.columns, "_turn", "status")
    )
    status = stage(status, "renamed")
    last = F.max(F.when(F.col("status") == "updated", F.struct("_turn", col)))
    named = status.groupBy(key).agg(last[col].alias(col)).filter(F.col(col).isNotNull())
    change = update_by_key(target, named, key, [col], skip_empty=False)
    return Change(change.after, change.affected, status.drop("_turn"))


def _accepted(turns: DataFrame, holders: DataFrame, large: int, folded: int) -> DataFrame:
    """The accepted ``_turn`` numbers of ``turns (_turn, _id, _name)``.

    Names held before the batch count as claims before the first turn.
    """
    before = (-F.monotonically_increasing_id() - 1).alias("_turn")  # of a written table, so it is fixed
    claims = turns.unionByName(holders.select(before, F.col("_holder").alias("_id"), "_name"))
    # A name with one claimer is never refused.
    # Its first turn stands for a name from here on, so no text travels in the rounds.
    names = claims.groupBy("_name").agg(
        (F.min("_id") != F.max("_id")).alias("_contested"), F.count(F.lit(1)).alias("_n"), F.min("_turn").alias("_first")
    )
    names = stage(names, "names")
    per_name = names.agg(F.max(F.when(F.col("_contested"), F.col("_n")))).first()[0] or 0
    per_id = largest_group(claims, ["_id"])
    claims = claims.join(names.drop("_n"), "_name").drop("_name").withColumnRenamed("_first", "_name")
    claims = next_in_group(claims, ["_id", "_name"], ["_turn"], F.col("_turn"), "_again", per_id, large)
    claims = stage(claims.withColumns({"_guess": F.lit(True), "_before": F.lit(True)}), "guess")
    while True:
        guess = F.when(F.col("_guess"), F.col("_turn"))
        ends = next_in_group(claims, ["_id"], ["_turn"], guess, "_end", per_id, large)
        ends = ends.withColumn("_end", F.least("_end", "_again"))
        if per_name <= folded:
            columns = ["_turn", "_id", "_name", "_again", "_guess", "_end"]
            open_ = _folded(ends.filter("_contested").select(*columns)).withColumn("_contested", F.lit(True))
            sure = ends.filter("NOT _contested").select(*columns[:-1], F.lit(True).alias("_now"), "_contested")
            judged = open_.unionByName(sure)
        else:
            taken = _chains(stage(ends.filter("_contested").select("_turn", "_name", "_end"), "ends"), 2 * per_name, large)
            judged = claims.join(taken.withColumn("_taken", F.lit(True)), "_turn", "left")
            judged = judged.withColumn("_now", ~F.col("_contested") | F.col("_taken").isNotNull())
        judged = judged.select(
            "_turn", "_id", "_contested", "_name", "_again", F.col("_now").alias("_guess"), F.col("_guess").alias("_before")
        )
        claims = stage(judged, "guess")
        if claims.filter("_guess <> _before").isEmpty():
            return claims.filter("_guess AND _turn >= 0").select("_turn")


def _folded(claims: DataFrame) -> DataFrame:
    """``claims``, their ends apart, with ``_now``: whether they hold their names in turn, for names of few claims."""
    never = F.lit((1 << 63) - 1)
    carried = [c for c in claims.columns if c not in ("_turn", "_name", "_end")]
    each = F.struct("_turn", F.coalesce("_end", never).alias("_end"), *carried)
    state = F.struct(F.lit(-(1 << 63)).alias("free"), F.array().cast("array<boolean>").alias("taken"))

    def step(held: Column, claim: Column) -> Column:
        takes = claim["_turn"] >= held["free"]
        free = F.when(takes, claim["_end"]).otherwise(held["free"])
        return F.struct(free.alias("free"), F.concat(held["taken"], F.array(takes)).alias("taken"))

    claimed = claims.groupBy("_name").agg(F.array_sort(F.collect_list(each)).alias("claim"))
    taken = claimed.select("_name", F.arrays_zip("claim", F.aggregate("claim", state, step)["taken"].alias("now")).alias("both"))
    one = taken.select("_name", F.explode("both").alias("one"))
    return one.select("one.claim._turn", "_name", *(f"one.claim.{c}" for c in carried), F.col("one.now").alias("_now"))


def _chains(claims: DataFrame, largest: int, large: int) -> DataFrame:
    """The same for names of any number of claims: from each end to the first claim since, doubling the way in each round."""
    own = claims.select("_name", F.col("_turn").alias("_at"), F.lit(1).alias("_kind"), F.col("_turn").alias("_from"), F.col("_turn").alias("_claim"))
    ends = claims.filter(F.col("_end").isNotNull())
    ends = ends.select("_name", F.col("_end").alias("_at"), F.lit(0).alias("_kind"), F.col("_turn").alias("_from"), F.lit(None).cast("long").alias("_claim"))
    found = next_in_group(own.unionByName(ends), ["_name"], ["_at", "_kind", "_from"], F.col("_claim"), "_to", largest, large)
    steps = stage(found.filter("_kind = 0 AND _to IS NOT NULL").select("_from", "_to"), "steps")
    reached = stage(claims.groupBy("_name").agg(F.min("_turn").alias("_turn")).select("_turn"), "reached")
    while True:
        further = stage(reached.join(steps, F.col("_turn") == F.col("_from")).select(F.col("_to").alias("_turn")), "reached")
        if further.isEmpty():
            return reached
        reached = stage(reached.unionByName(further).distinct(), "reached")
        ahead = steps.select(F.col("_from").alias("_to"), F.col("_to").alias("_then"))
        steps = stage(steps.join(ahead, "_to").select("_from", F.col("_then").alias("_to")), "steps")
