"""Replacement of phrases by a dictionary of any size.

``dict_replace`` is for dictionaries that fit into a pattern.  Here the dictionary is a
table: it becomes automatons in flat arrays (``functions.automaton``), which every task
reads; texts stay where they are, nothing is shuffled and no id is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postweave.functions.automaton import PhraseTable, leftmost, replaced, spans_index, text_buffer

#: Bytes of keys and values, with what the arrays add, in one automaton.
PART_BYTES = 64 << 20
#: Bytes of all automatons; they lie on every executor.
TOTAL_BYTES = 4 << 30
#: Bytes that a key costs besides its own, about.
KEY_COST = 64
#: Text bytes handled at once: all parts are read for each.
SLICE_BYTES = 8 << 20


def _entries(dictionary: DataFrame) -> DataFrame:
    """``key, value, ord`` with one row per key: the first in order."""
    rows = dictionary.where("key is not null and key <> '' and value is not null and ord is not null")
    first = rows.groupBy("key").agg(F.min_by("value", F.struct("ord", "value")).alias("value"), F.min("ord").alias("ord"))
    return first.withColumn("head", F.hex(F.substring(F.encode("key", "UTF-8"), 1, 2)))


def _parts(entries: DataFrame, part_bytes: int) -> list[tuple[list[str], int, int]]:
    """Parts of the dictionary by the first two bytes of keys, at most 65,792 groups of them:
    ``heads, share, shares``.  A group beyond ``part_bytes`` is shared out by hash."""
    size = F.sum(F.octet_length("key") + F.octet_length("value") + KEY_COST)
    groups = entries.groupBy("head").agg(size.alias("size")).orderBy("head").collect()
    total = sum(r["size"] for r in groups)
    if total > TOTAL_BYTES:
        raise ValueError(f"a dictionary of {total} bytes is beyond {TOTAL_BYTES} bytes on every executor")
    parts: list[tuple[list[str], int, int]] = []
    held, room = [], part_bytes
    for head, size in groups:
        if size > part_bytes:
            shares = -(-size // part_bytes)
            parts += [([head], share, shares) for share in range(shares)]
            continue
        if size > room:
            parts.append((held, 0, 1))
            held, room = [], part_bytes
        held.append(head)
        room -= size
    return parts + ([(held, 0, 1)] if held else [])


def _broadcast(entries: DataFrame, part_bytes: int) -> list[Broadcast]:
    """An automaton for each part; the driver holds one of them at a time."""
    spark = entries.sparkSession
    tables = []
    for heads, share, shares in _parts(entries, part_bytes):
        rows = entries.where(F.col("head").isin(heads) & (F.pmod(F.xxhash64("key"), F.lit(shares)) == share))
        rows = rows.select("key", "value", F.col("ord").cast("long").alias("ord")).toArrow()
        keys, values = (rows.column(c).combine_chunks() for c in ("key", "value"))
        tables.append(spark.sparkContext.broadcast(PhraseTable.build(keys, values, rows.column("ord").to_numpy())))
    return tables


def replace_phrases(df: DataFrame, text: str, dictionary: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with every phrase of ``dictionary(ord, key, value)`` in column ``text`` replaced.

    All replacements are simultaneous: the leftmost match counts, of several keys at one
    place the first by ``ord`` (equal ``ord``: the shorter key), as in
    ``functions.text.dict_replace``.  Keys are literal and may hold spaces.

    The dictionary's size is measured.  Up to ``part_bytes`` it is one automaton; a larger
    one is split by the first bytes of its keys, and a task reads one part at a time, whatever
    the size, up to ``TOTAL_BYTES``.  A null text stays null; entries with a null or an
    empty key are left out; a repeated key has its first value.
    """
    # The parts are read one by one; were the cache lost, it would be computed again.
    entries = _entries(dictionary).persist()
    tables = _broadcast(entries, part_bytes)
    entries.unpersist()
    names = df.columns
    at = names.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                column = _rewritten(part.column(at), tables)
                columns = [*part.columns[:at], column, *part.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(rewrite, df.schema) if tables else df


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts pass the bound; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    shares = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    edges = np.flatnonzero(np.append(True, shares[1:] != shares[:-1])) if len(sizes) else np.zeros(0, int)
    for a, b in zip(edges, np.append(edges[1:], len(sizes))):
        yield batch.slice(a, b - a)


def _rewritten(texts: pa.Array, tables: list[Broadcast]) -> pa.Array:
    data, offsets = text_buffer(texts)
    stops = np.repeat(offsets[1:], np.diff(offsets))
    at, rank, length, begin, size = (np.zeros(0, np.int64) for _ in range(5))
    pieces, held = [], 0
    for table in tables:
        part = table.value
        if len(tables) > 1:
            # The worker lets the part go with this turn, and reads it again for the next slice.
            vars(table).pop("_value", None)
        places, key = part.best(data, stops)
        sizes = part.value_start[key + 1] - part.value_start[key]
        pieces.append(part.value_data[spans_index(part.value_start[key], sizes)])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] + held
        held += len(pieces[-1])
        at, rank = np.concatenate([at, places]), np.concatenate([rank, part.key_rank[key]])
        length = np.concatenate([length, part.key_start[key + 1] - part.key_start[key]])
        begin, size = np.concatenate([begin, starts]), np.concatenate([size, sizes])
    # Of several parts that know a key at one place, the first by rank.
    order = np.lexsort((length, rank, at))
    first = np.ones(len(order), bool)
    first[1:] = at[order][1:] != at[order][:-1]
    at, length, begin, size = (a[order][first] for a in (at, length, begin, size))
    taken = leftmost(at, length)
    if not len(taken):
        return texts
    values = np.concatenate(pieces)
    out, edges = replaced(data, offsets, at[taken], length[taken], values, begin[taken], size[taken])
    column = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)])
    column = column.cast(texts.type)
    return pc.if_else(texts.is_valid(), column, pa.scalar(None, texts.type)) if texts.null_count else column
