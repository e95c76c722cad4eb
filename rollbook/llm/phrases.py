"""Phrase collocations: a multikey quicksort of suffixes, routed by their leading words.

Texts are cut into pieces at punctuation and line ends, pieces into words. Each word begins a suffix
of up to ``DEPTH`` words of its piece. Suffixes are routed over the cluster by their
first two words; then all that begin with a phrase lie in one slot, which is sorted by
three-way partitions on the word at each depth: the size of an equal partition is
the count of its phrase, and a partition smaller than ``min_count`` is abandoned with all
that it holds. Beforehand, single words are counted and suffixes end before infrequent
words, which no frequent phrase holds; equal suffixes of a batch are sent once with a count.

Where two leading words are so common that they would overfill a slot, their suffixes are routed by three
words, and if need be by four or five; the counts of the shorter phrases, which then lie in
several slots, are summed. Which are so common is told by counts of their hashes.

Candidates, cuts and ranks are then joins and windows over the frequent phrases. A null language is
``und``; null and empty texts have no words. Repeated rows count as often as they occur. Words are told apart by 64-bit
hashes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.blocks import LOWER, Block, Hasher, blocks, mix
from rollbook.llm.tables import stage
from rollbook.plans.sizing import hint_by_size

DEPTH = 5
MIN_COUNT = 100
TOP = 2000
#: Frequent words up to this number are sent to all tasks (8 bytes each) and get short ids; beyond it their hashes are their ids.
MAX_IDS = 4_000_000
#: Suffixes that a slot is meant to hold, and those that a task gathers before it sends them.
SLOT = 1 << 20
GATHERED = 3 << 19
_SENT = 1 << 18  # suffixes that are dealt at a time
_BYTES_PER_WORD = 6  # only to size slots
_SALTS = 64

_BLOCK_BYTES = 1 << 21
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[list(b" \x09")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_BINS = "bins"


def _language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a block: their keys (hash of language and word), and whether the next word follows in the same piece."""

    def __init__(self, block: Block, langs: np.ndarray):
        self.data = LOWER[block.data]
        self.starts, self.ends, self.before = block.pieces(~_BETWEEN[self.data])
        self.of = np.repeat(np.arange(block.n), np.diff(self.before))
        self.keys = mix(Hasher(self.data)(self.starts, self.ends) ^ langs[self.of]) | np.uint64(1)
        self.linked = np.zeros(len(self.keys), bool)
        if len(self.keys) > 1:
            breaks = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum(_BREAK[self.data], out=breaks[1:])
            self.linked[:-1] = (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) & (self.of[1:] == self.of[:-1])


def _shifted(values: np.ndarray, j: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[: len(values) - j] = values[j:]
    return out


def _runs(links: np.ndarray) -> list[np.ndarray]:
    """For j = 1, 2, ...: whether the word j places on belongs to the same run of linked words."""
    out = [links]
    for j in range(1, DEPTH - 1):
        out.append(out[-1] & _shifted(links, j))
    return out


def _leading(keys: np.ndarray, runs: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the first two, three, ... words of each suffix; missing words are 0."""
    out, total = [], keys
    for j, inside in enumerate(runs, 1):
        total = mix(total * _STEP + np.where(inside, _shifted(keys, j), 0).astype(np.uint64))
        out.append(total)
    return out


def _block_langs(batch: pa.RecordBatch, block: Block, known: dict[str, int]) -> np.ndarray:
    names = batch.column(0).slice(block.first, block.n).to_pylist()
    for lang in set(names) - known.keys():
        known[lang] = _language(lang)
    return np.array([known[lang] for lang in names], np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("`lang`").cast("string"), F.lit("und")).alias("lang"), F.col("`text`").alias("text"))


def word_counts(docs: DataFrame, min_count: int, n_bins: int) -> DataFrame:
    """Written counts: ``lang, word, key, n`` of each word that occurs ``min_count`` times or more.

    Beside them, rows without a word: the total of each ``lang`` (``key`` 0), and, for the ``lang`` 'bins',
    how many suffixes have leading words of each hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        bins = np.zeros((DEPTH - 2) * n_bins, np.int64)
        for batch in batches:
            langs = batch.column(0)
            for block in blocks(batch.column(1), _BLOCK_BYTES):
                own = _block_langs(batch, block, known)
                w = Words(block, own)
                for j, hashes in enumerate(_leading(w.keys, _runs(w.linked)[:-1])):
                    bins[j * n_bins : (j + 1) * n_bins] += np.bincount((hashes[w.linked] % np.uint64(n_bins)).astype(np.int64), minlength=n_bins)
                keys, first, counts = np.unique(w.keys, return_index=True, return_counts=True)
                names = langs.slice(block.first, block.n)
                texts = [w.data[a:b].tobytes() for a, b in zip(w.starts[first], w.ends[first], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(w.of[first])), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(counts), pa.array(np.zeros(len(keys), bool))], _COUNTED
                )
                per_text = np.diff(w.before)
                yield _bare(names, np.zeros(block.n, np.int64), per_text, False)
        at = np.flatnonzero(bins)
        yield _bare(pa.array([_BINS] * len(at), pa.string()), at, bins[at], True)

    parts = _texts(docs).mapInArrow(run, "lang string, word string, key long, n long, bin boolean")
    sums = parts.groupBy("lang", "key", "bin").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    return stage(sums.where(F.col("word").isNull() | (F.col("n") >= min_count)), "word-counts")


_COUNTED = ["lang", "word", "key", "n", "bin"]


def _bare(langs: pa.Array, keys: np.ndarray, counts: np.ndarray, bin_: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(keys), pa.array(counts), pa.array(np.full(len(langs), bin_))], _COUNTED)


def partitions(ids: np.ndarray, weight: np.ndarray, whole: int, min_count: int) -> Iterator[tuple[int, int, int]]:
    """Multikey quicksort of suffixes ``ids`` (one row for each depth): ``depth, row, count`` of each equal partition.

    All suffixes with the same first ``whole`` words are given, so a partition whose phrases are that
    long is abandoned below ``min_count``; of shorter phrases, from two words, every count is returned. ``row`` is one of the suffixes.
    """
    pending = [(np.arange(ids.shape[1]), 0)]
    while pending:
        rows, depth = pending.pop()
        if max(depth + 1, 2) >= whole and (len(rows) == 0 or weight[rows].sum() < min_count):
            continue
        column = ids[depth][rows]
        ended = column == 0
        if ended.any():
            rows, column = rows[~ended], column[~ended]
        if not len(rows):
            continue
        pivot = np.partition(column[:: max(1, len(column) // 9)], min(len(column), 9) // 2)[min(len(column), 9) // 2] if len(column) > 2 else column[0]
        equal = column == pivot
        less = column < pivot
        if not equal.all():
            pending.append((rows[less], depth))
            pending.append((rows[~(less | equal)], depth))
            rows = rows[equal]
        if depth:
            count = int(weight[rows].sum())
            if count >= min_count or depth + 1 < whole:
                yield depth + 1, int(rows[0]), count
        if depth + 1 < len(ids):
            pending.append((rows, depth + 1))


def _frequent_pairs(ids: np.ndarray, weight: np.ndarray, min_count: int) -> np.ndarray:
    """Suffixes without those whose first two words are surely infrequent, told by sums over hashes."""
    pair = mix(ids[0].astype(np.uint64) * _STEP + ids[1].astype(np.uint64)) >> np.uint64(64 - _FILTER_BITS)
    return np.bincount(pair.astype(np.int64), weight)[pair.astype(np.int64)] >= min_count


def phrase_counts(docs: DataFrame, counts: DataFrame, min_count: int, slots: int, n_bins: int, max_ids: int = MAX_IDS) -> DataFrame:
    """``words`` (their keys) and count ``f`` of each phrase of two words or more that occurs ``min_count`` times or more."""
    spark = docs.sparkSession
    keys = counts.where("word is not null").select("key")
    short = keys.count() <= max_ids
    ordered = np.sort(keys.toArrow().column("key").to_numpy().view(np.uint64)) if short else np.zeros(0, np.uint64)
    total = counts.where("key = 0 and not bin").agg(F.sum("n")).first()[0] or 0
    # Bins hold a sixteenth of a slot on average; those above two slots' share are routed by more words.
    hot = counts.where(F.col("bin") & (F.col("n") > max(4 * min_count, 2 * total // slots))).select("key").toArrow()
    is_hot = np.zeros((DEPTH - 2) * n_bins, bool)
    is_hot[hot.column("key").to_numpy()] = True
    sent = spark.sparkContext.broadcast((ordered, np.packbits(is_hot)))
    width = np.dtype(np.uint32 if short else np.uint64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        ordered, bits = sent.value
        is_hot = np.unpackbits(bits, count=(DEPTH - 2) * n_bins).astype(bool)
        held = Gathered(width, (DEPTH - 1) * slots, GATHERED)
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = Words(block, _block_langs(batch, block, known))
                ids = _ids(w.keys, ordered, short)
                links = w.linked & (ids > 0) & _shifted(ids > 0, 1)
                runs = _runs(links)
                mine = np.flatnonzero(links)
                if not len(mine):
                    continue
                leading = [h[mine] for h in _leading(w.keys, runs)]
                slot = leading[0] % np.uint64(slots)
                deeper = np.ones(len(mine), bool)
                for j in range(DEPTH - 2):
                    deeper &= is_hot[(leading[j] % np.uint64(n_bins)).astype(np.int64) + j * n_bins]
                    slot = np.where(deeper, leading[j + 1] % np.uint64(slots) + np.uint64((j + 1) * slots), slot)
                columns = [ids[mine], *(np.where(r[mine], _shifted(ids, j)[mine], 0) for j, r in enumerate(runs, 1))]
                yield from held.add(columns, slot, leading[-1])
        yield from held.dealt()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = sent.value[0]
        for slot, parts in _by_slot(batches):
            both = np.concatenate([np.frombuffer(p, width).reshape(DEPTH + 1, -1) for p in parts], 1)
            ids, weight = both[:-1], both[-1].astype(np.int64)
            whole = slot // slots + 2
            if whole == 2:
                kept = _frequent_pairs(ids, weight, min_count)
                ids, weight = ids[:, kept], weight[kept]
            found = list(partitions(ids, weight, whole, min_count))
            if found:
                depth, row, count = np.array(found, np.int64).T
                inside = np.arange(DEPTH) < depth[:, None]
                flat = ids[:, row].T[inside]
                flat = ordered[flat - 1] if short else flat
                offsets = np.concatenate([[0], np.cumsum(depth)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64))), pa.array(count)], ["words", "f"])

    routed = _texts(docs).mapInArrow(route, "slot int, suffixes binary").repartition("slot").sortWithinPartitions("slot")
    nodes = routed.mapInArrow(sort, "words array<long>, f long")
    return stage(nodes.groupBy("words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrases")


def _ids(keys: np.ndarray, ordered: np.ndarray, short: bool) -> np.ndarray:
    """1 and on for frequent words, 0 for others; the keys themselves if there are too many for ids."""
    if not short:
        return keys
    at = np.searchsorted(ordered, keys)
    found = ordered[np.minimum(at, len(ordered) - 1)] == keys if len(ordered) else np.zeros(len(keys), bool)
    return np.where(found, at + 1, 0).astype(np.uint32)


class Gathered:
    """Suffixes on their way to ``slots`` slots, in arrays that are filled and dealt over and over."""

    def __init__(self, width: np.dtype, slots: int, room: int):
        self.ids = np.empty((DEPTH, room), width)
        # The slot above as many bits of the suffix's hash as there is room for.
        self.keys = np.empty(room, np.uint64)
        self.bits = np.uint64(slots.bit_length())
        self.below = np.uint64(64) - self.bits
        self.n = 0

    def add(self, columns: list[np.ndarray], slot: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take suffixes in; when the arrays are full, what they hold is dealt."""
        done, room = 0, len(self.keys)
        while done < len(slot):
            more = min(len(slot) - done, room - self.n)
            to, some = slice(self.n, self.n + more), slice(done, done + more)
            for own, column in zip(self.ids, columns, strict=True):
                own[to] = column[some]
            self.keys[to] = (slot[some].astype(np.uint64) << self.below) | (hashes[some] >> self.bits)
            self.n += more
            done += more
            if self.n == room:
                yield from self.dealt()

    def dealt(self) -> Iterator[pa.RecordBatch]:
        """A row for each slot, with its suffixes and their counts; equal suffixes are one."""
        order = np.argsort(self.keys[: self.n])
        slots = self.keys[order] >> self.below
        begin = 0
        while begin < self.n:
            end = int(np.searchsorted(slots, slots[min(begin + _SENT, self.n) - 1], "right"))
            yield _rows(self.ids[:, order[begin:end]], slots[begin:end].astype(np.int64))
            begin = end
        self.n = 0


def _rows(ids: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    for row in ids:
        new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(slot)))
    table = np.concatenate([ids[:, first], counts[None].astype(ids.dtype)])
    slot = slot[first]
    begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    pieces = [table[:, a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(slot)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(slot[begin].astype(np.int32)), pa.array(pieces, pa.binary())], ["slot", "suffixes"])


def _by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    now, parts = None, []
    for batch in batches:
        for slot, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if slot != now and parts:
                yield now, parts
                parts = []
            now = slot
            parts.append(part.as_py())
    if parts:
        yield now, parts


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(phrases: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language, of ``phrase_counts`` and ``word_counts``."""
    words = counts.where("word is not null").select("key", "lang", "word", F.col("n").alias("f"))
    totals = counts.where("key = 0 and not bin").select("lang", "n")
    of_word, of_lang = hint_by_size(words), hint_by_size(totals)
    # All frequent phrases, single words among them, by their keys.
    known = phrases.unionByName(words.select(F.array("key").alias("words"), "f"))
    a = phrases.withColumnRenamed("f", "a").withColumn("key", F.col("words")[0])
    a = a.join(of_word(words.select("key", "lang")), "key").join(of_lang(totals), "lang")
    size = F.size("words")
    cut = a.select("lang", "words", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(known.toDF("first", "l"), "first").join(known.toDF("rest", "r"), "rest")
    # Products are below 10^38 while a corpus has fewer than 10^17 words.
    product = F.lit(1000).cast("decimal(4,0)") * _exact("a").cast("decimal(17,0)") * _exact("n").cast("decimal(17,0)")
    below = _exact("l") * _exact("r")
    cut = stage(cut.withColumn("score", F.call_function("div", product, below)), "cuts")
    # A phrase inside a longer one of the same count lies inside one that is a word longer, with that count.
    inside = cut.where((F.size("first") == size - 1) & (F.col("l") == F.col("a")) & (size > 2)).select(F.col("first").alias("words"))
    inside = inside.union(cut.where((F.size("rest") == size - 1) & (F.col("r") == F.col("a")) & (size > 2)).select("rest")).distinct()
    lowest = cut.groupBy("words", "lang", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("n").alias("n"))
    kept = lowest.join(inside, "words", "left_anti").select("lang", "words", "a", "low.l", "low.r", "n", "low.score")
    # Thinned out in parts of each language first, equal scores and counts kept.
    order = [F.desc("score"), F.desc("a")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(_SALTS)))
    for group in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= top)
    ranked = stage(salted.drop("place", "salt"), "ranked")
    each = ranked.select("lang", "words", F.posexplode("words").alias("at", "key")).join(of_word(words.select("key", "word")), "key")
    texts = each.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    rows = ranked.join(texts, ["lang", "words"]).withColumn("rank", number.cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, max_ids: int = MAX_IDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language of ``docs``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("`text`"))).first()[0] or 0
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(4 * at_once, -(-int(size) // _BYTES_PER_WORD // SLOT))
    n_bins = max(1 << 14, 1 << (16 * slots - 1).bit_length())
    counts = word_counts(docs, min_count, n_bins)
    return collocations(phrase_counts(docs, counts, min_count, slots, n_bins, max_ids), counts, top)


def oracle_sql() -> str:
    """The rows of ``mined`` over ``documents`` in DuckDB's SQL."""
    joined = "array_to_string(ws[{}], ' ')"
    return rf"""with pieces as (
            select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (
                select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
                from documents)),
        grams as (select lang, size, {joined.format("i:i + size - 1")} as phrase
            from (select *, unnest(range(1, len(ws) - size + 2)) as i from pieces, range(1, {DEPTH + 1}) t(size) where len(ws) >= size)),
        total as (select lang, count(*)::hugeint as n from grams where size = 1 group by lang),
        f as materialized (select lang, size, phrase, count(*)::hugeint as f from grams group by all having count(*) >= {MIN_COUNT}),
        candidate as (select *, string_split(phrase, ' ') as ws from f where size > 1),
        cut as materialized (select c.lang, c.size, c.phrase, c.f as a, c.k, x.f as l, y.f as r, n, 1000 * c.f * n // (x.f * y.f) as score, x.phrase as first, y.phrase as rest
            from (select *, unnest(range(1, size)) as k from candidate) c join total using (lang)
            join f x on x.lang = c.lang and x.phrase = {joined.format("1:k").replace("ws", "c.ws").replace(":k", ":c.k")}
            join f y on y.lang = c.lang and y.phrase = {joined.format("k + 1:").replace("ws", "c.ws").replace("[k", "[c.k")}),
        low as (select lang, phrase, a, n, arg_min({{'l': l, 'r': r, 's': score}}, (score, k)) as b from cut group by all),
        dropped as (select distinct a.lang, a.phrase from candidate a join candidate b on a.lang = b.lang and b.size > a.size and b.f >= a.f
            and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')),
        kept as (select * from low anti join dropped using (lang, phrase))
        select lang, rank, phrase, a::bigint as a, b.l::bigint as l, b.r::bigint as r, n::bigint as n, b.s::bigint as score from (
            select *, row_number() over (partition by lang order by b.s desc, a desc, phrase) as rank from kept) where rank <= {TOP}"""
