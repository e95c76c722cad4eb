"""Spelling variants: words one edit apart, found by dense tiles of code-point matrices.

Words are counted over all documents (``counted``). Two words are near if they differ by exactly one
inserted, deleted or replaced code point, that is, if their common prefix and common suffix
together reach the longer word's length less one. One of the two then
covers at least half of the longer word, so near words share a block: the
first, or the last, ``L // 2`` code points, where L is the longer length. Blocks are compared in tiles: the words of a block as rows of
padded matrices, aligned left for prefixes and right for suffixes, all rows against
all rows a column at a time. A block of more than ``TILE`` words is dealt
into tiles and each pair of tiles is a unit of work of its own, so no block is gathered in
one task. Tiles return counts and best partners for each word, not pairs.

A word's ``form`` is its near word of largest count (ties: smallest by code points) if that
count is at least ``RATIO`` times its own; its ``root`` is the end of the chain of forms.

Null and empty texts have no words; a null id counts as ''. Repeated rows count as often as they occur. Runs and words may have any
length. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import IS_FIRST, LOWER, Block, Hasher, blocks
from rollbook.llm.tables import stage
from rollbook.plans.sizing import hint_by_size

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
#: A run loses a code point if this divides its checksum.
NOISE = 199
#: Words of a tile.
TILE = 256

_BLOCK_BYTES = 1 << 21
_LONG_RUN = 64  # bytes; longer runs are checked one by one
_CELLS = 1 << 21  # of the comparisons made together

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("a") : ord("z") + 1] = True
_LATIN = 0xC3  # leads U+00C0 to U+00FF in UTF-8


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of each byte range of ``data`` after what ``heads`` already are the crc32 of."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    n_long = int(np.searchsorted(-sizes[order], -_LONG_RUN, "left"))
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(heads[i]))
    order = order[n_long:]
    state, at, left = ~heads[order], starts[order], sizes[order]
    for j in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -j, "left"))  # runs longer than j come first
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + j]) & 0xFF] ^ (state[:k] >> 8)
    out[order] = ~state
    return out


def block_words(block: Block, ids: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a block's texts and how often they occur, noise applied."""
    data = LOWER[block.data]
    lead = data == _LATIN
    inside = _IS_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, before = block.pieces(inside)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(IS_FIRST[data], out=chars[1:])
    of = np.repeat(np.arange(block.n), np.diff(before))
    n_chars = chars[ends] - chars[starts]
    long = n_chars >= MIN_CHARS
    starts, ends, of, n_chars = starts[long], ends[long], of[long], n_chars[long]
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    sums = checksums(data, starts, ends, heads[of]) if len(starts) else np.zeros(0, np.uint32)
    noisy = sums % NOISE == 0
    odd: Counter = Counter()
    for i in np.flatnonzero(noisy & (n_chars > MIN_CHARS)):
        run = data[starts[i] : ends[i]].tobytes().decode()
        at = int(sums[i]) % len(run)
        odd[(run[:at] + run[at + 1 :]).encode()] += 1
    plain = np.flatnonzero(~noisy)
    _, first, counts = np.unique(Hasher(data)(starts[plain], ends[plain]), return_index=True, return_counts=True)
    first = plain[first]
    words = [data[a:b].tobytes() for a, b in zip(starts[first], ends[first], strict=True)]
    return [*words, *odd], np.concatenate([counts, np.fromiter(odd.values(), np.int64, len(odd))])


def counted(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of each word that occurs ``min_count`` times or more, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1), _BLOCK_BYTES):
                words, counts = block_words(block, ids[block.first : block.first + block.n])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")).alias("id"), F.col("`text`").alias("text"))
    parts = texts.mapInArrow(run, "word string, n long")
    return stage(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")


def units(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``words`` once for each unit of work they belong to.

    A unit is a block (``side``, ``longer`` length and ``block``) or, of a block of more than ``tile``
    words, a pair of its tiles.
    """
    size = F.length("word")
    entries = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    entries = entries.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.floor(F.col("longer") / 2).cast("int")
    shared = F.when(F.col("side") == 0, F.substr("word", F.lit(1), half)).otherwise(F.substr("word", size - half + 1, half))
    entries = entries.withColumn("block", F.xxhash64(shared))
    blocks_ = entries.groupBy("side", "longer", "block").agg(F.count("*").alias("members")).where("members > 1")
    tiles = F.ceil(F.col("members") / tile).cast("int")
    dealt = entries.join(blocks_, ["side", "longer", "block"]).withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("word", F.lit("tile")), tiles).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return dealt.withColumn("other", other).select(
        "side", "longer", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "word", "n"
    )


def _matrices(words: list[str], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as rows, aligned left and aligned right, padded with 0."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((2, len(words), width), np.uint32)
    left[row, inner] = flat
    right[row, inner + width - sizes[row]] = flat
    return left, right


def _common(rows: np.ndarray) -> np.ndarray:
    """The number of equal leading columns of all pairs of rows in each tile (tiles, rows, columns)."""
    n, s, width = rows.shape
    out = np.zeros((n, s, s), np.int32)
    same = np.ones((n, s, s), bool)
    for c in range(width):
        column = rows[:, :, c]
        same &= column[:, :, None] == column[:, None, :]
        if not same.any():
            break
        out += same
    return out


def near_in_units(words: list[str], unit: np.ndarray, side: np.ndarray, longer: np.ndarray, crossed: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number of near rows in its unit, and the first of them (-1: none).

    Rows of a unit stand together, in the order in which partners are preferred. In a ``crossed`` unit only
    rows of different tiles meet.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    members = np.diff(np.append(begin, len(words)))
    # Tiles of like size and width are compared together; both are rounded up to powers of 2.
    shape = np.stack([np.ceil(np.log2(np.maximum(members, 2))), np.ceil(np.log2(longer[begin]))], 1).astype(np.int64)
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for kind in np.unique(shape, axis=0):
        mine = np.flatnonzero((shape == kind).all(1) & (members > 1))
        s = int(members[mine].max(initial=0))
        together = max(1, _CELLS // max(1, s * s))
        for at in range(0, len(mine), together):
            of = mine[at : at + together]
            index = begin[of, None] + np.arange(s)
            real = np.arange(s) < members[of, None]
            index = np.where(real, index, begin[of, None])
            flat, back = np.unique(index, return_inverse=True)
            width = int(sizes[flat].max())
            left, right = _matrices([words[i] for i in flat], sizes[flat], width)
            back = back.reshape(index.shape)
            prefix = _common(left[back])
            suffix = _common(right[back][:, :, ::-1])
            n = sizes[index]
            most = np.maximum(n[:, :, None], n[:, None, :])
            long = longer[begin[of]][:, None, None]
            half = long // 2
            # A pair that shares both halves counts on the prefix's side.
            here = np.where(side[begin[of]][:, None, None] == 0, prefix >= half, (suffix >= half) & (prefix < half))
            near = (prefix + suffix >= most - 1) & (most == long) & here & real[:, :, None] & real[:, None, :]
            t = tile[index]
            near &= ~crossed[begin[of]][:, None, None] | (t[:, :, None] != t[:, None, :])
            near[:, np.arange(s), np.arange(s)] = False
            found = near.sum(2)
            has = found > 0
            count[index[has]] = found[has]
            best[index[has]] = (begin[of, None] + near.argmax(2))[has]
    return count, best


_UNIT = ["side", "longer", "block", "a", "b"]


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n_near`` and the best near word (``best, best_n``) of each word of ``words (word, n)`` that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in _UNIT]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            done = int(changes[-1]) if len(changes) else 0
            rest = table.slice(done).combine_chunks()
            if done:
                yield from compared(table.slice(0, done))
        if rest is not None:
            yield from compared(rest)

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, longer, block, a, b, tiles = (table.column(c).to_numpy() for c in [*_UNIT, "tile"])
        unit = np.concatenate([[0], np.cumsum(np.any([k[1:] != k[:-1] for k in (side, longer, block, a, b)], 0))])
        words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        count, best = near_in_units(words, unit, side, longer, a != b, tiles)
        rows = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in rows], pa.string()), pa.array(count[rows]), pa.array(counts[best[rows]]), pa.array([words[i] for i in best[rows]], pa.string())],
            ["word", "near", "best_n", "best"],
        )

    dealt = units(words, tile).repartition(*_UNIT).sortWithinPartitions(*_UNIT, F.desc("n"), "word")
    parts = dealt.mapInArrow(run, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    found = parts.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first"))
    return found.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of each ``word, form``: where the chain of forms ends. Counts grow along it, so it does.

    Each round doubles the steps taken and is written.
    """
    ends = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(ends.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ends = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return ends


def variants(words: DataFrame, tile: int = TILE, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words (word, n)``, whose words are distinct."""
    near = words.join(near_words(words, tile), "word", "left")
    near = near.withColumn("has", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    judged = stage(
        near.select("word", F.when(F.col("has"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n")),
        "forms",
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(hint_by_size(ends)(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spellings(docs: DataFrame) -> DataFrame:
    """The spelling variants among the words of ``docs``."""
    return variants(counted(docs))


def oracle_sql() -> str:
    """The rows of ``spellings`` over ``documents`` in DuckDB's SQL: near words share a word less one code point."""
    return rf"""with recursive crc_table as (
            select list(v order by i) as crc from (
                select i, list_reduce(list_prepend(i, range(8)), lambda v, step: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) as v
                from range(256) t(i))),
        runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
            from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents) where length(run) >= {MIN_CHARS} group by all),
        bytes as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from runs),
        summed as (select run, n, xor(list_reduce(
                list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                lambda s, b: xor(crc[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) as h from bytes, crc_table),
        noised as (select n, case when h % {NOISE} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from summed),
        words as materialized (select word, sum(n)::bigint as n from noised where length(word) >= {MIN_CHARS} group by word having sum(n) >= {MIN_COUNT}),
        cuts as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from words, unnest(range(1, length(word) + 1)) t(i)),
        pairs as (
            select a.word, b.word as other, b.n as other_n from cuts a join cuts b using (i, less) where a.word <> b.word
            union select a.word, b.word, b.n from cuts a join words b on a.less = b.word
            union select b.word, a.word, a.n from cuts a join words b on a.less = b.word),
        best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from pairs group by word),
        forms as materialized (select word, n, coalesce(n_near, 0) as n_near, case when other_n >= {RATIO} * n then other end as form,
            case when other_n >= {RATIO} * n then other_n end as form_n from words left join best using (word)),
        chain as (select word, word as stop, 0 as step from forms union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.stop where f.form is not null)
        select word, form, arg_max(stop, step) as root, n, n_near, form_n from forms join chain using (word) group by all"""
