"""Byte-level substring dedup by suffix arrays: remove what an earlier document holds.

A window is a string of 50 bytes of one document; it is late if it also starts in a document
with a smaller id.

1. Each window has a key, the least hash of its 24-byte strings, so equal windows have equal
   keys and neighbours mostly share one.  Keys meet by range; those of a single
   document need no further look.
2. The windows with a revealed key are gathered into shards of a few megabytes.
   A shard gets its suffix array (Larsson-Sadakane) and common prefixes (Kasai): windows of
   one class are equal, byte by byte, and all but those of its smallest document are late.
3. What a shard could not settle is merged across shards, by range of keys: stretches of
   windows with one key travel as their bytes.  Equal stretches are settled as one; where
   a key has different stretches, each shard's windows are looked up in the sorted
   list of all by binary search, and the smallest document of each decides.
4. Late windows are joined to runs of each text, and their bytes removed.

Keys only choose what is compared; bytes decide every row.  A row is addressed by a hash of
id and text, so rows that repeat an id keep their own runs.  A key or passage of a
third of all rows is one entry per gathering and shard, not one per document.  At the rim of
such a passage stretches differ from document to document: those still meet by key, about
a hundred bytes for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import SLICE_BYTES, read_table, slices
from postweave.llm.suffixes import common_prefixes, suffix_array
from postweave.llm.words import mix, raw, window_starts

WIDTH = 50
#: Bytes of the strings whose hashes name a window; a multiple of 8.
GRAM = 24
#: Text bytes whose keys meet in one task, and whose stretches do.
KEY_RANGE, TEXT_RANGE = 48 << 20, 16 << 20
#: Entries and candidate bytes that a task gathers before it settles them.
ENTRIES, SHARD = 2_000_000, 2 << 20
#: Windows of a stretch at most.
STRETCH = 128
#: Bytes of strings sorted at once.
_STRINGS = 32 << 20

_KEYS = "bucket int, kind int, keys binary, rows binary"
_TEXTS = "bucket int, settled boolean, keys binary, docs binary, rows binary, spots binary, sizes binary, data binary"
_BACK = "bucket int, rows binary, found binary"
_PER_ROW = "row long, found binary"

_ALONE, _KNOWN, _SETTLED = 0, 1, 2


def window_keys(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A key of each ``width`` bytes of ``data``: the least hash of the grams inside."""
    grams = len(data) - GRAM + 1
    if len(data) < width:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    least = np.zeros(grams, np.uint64)
    for at in range(0, GRAM, 8):
        least *= np.uint64(0x9E3779B97F4A7C15)
        least += eight[at : at + grams]
    least = mix(least)
    span, reach = width - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(data) - width + 1], least[span - reach :])


def _pieces(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple]:
    """``part, data, edges, base``: the rows of a slice, or a piece of one long text at ``base``.

    Pieces overlap by a window less a byte, so that every window is in one of them.
    """
    for part in slices(batch, column):
        data, edges = raw(part.column(column))
        if len(part) > 1 or len(data) <= 2 * SLICE_BYTES:
            yield part, data, edges, 0
            continue
        for at in range(0, len(data) - width + 1, SLICE_BYTES):
            piece = data[at : at + SLICE_BYTES + width - 1]
            yield part, piece, np.array([0, len(piece)]), at


def _windows(data: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside documents, their keys and their documents' places."""
    at = window_starts(edges, width)
    keys = window_keys(data, width)[at] if len(at) else np.zeros(0, np.uint64)
    return at, keys, np.searchsorted(edges, at, side="right") - 1


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _record(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_KEYS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary())])
_TEXTS_ARROW = pa.schema(
    [("bucket", pa.int32()), ("settled", pa.bool_())]
    + [(c, pa.binary()) for c in ("keys", "docs", "rows", "spots", "sizes", "data")]
)


def _split(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, and ``bucket, from, to`` in it."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = _cuts(bucket).tolist()
    return order, [(int(bucket[a]), a, b) for a, b in zip(edges, [*edges[1:], len(bucket)])]


def _pack(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed, with their number in front."""
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True) if packed else b""


def _bytes(group: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(map(_unpack, group.column(column).to_pylist())), kind)


# Keys


def _meeting(keys: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys of one gathering: those that several of its rows have are revealed to all of them
    and pass on as known; the others pass on with their row."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    distinct = _cuts(keys, rows)
    keys, rows = keys[distinct], rows[distinct]
    first = np.zeros(len(keys), bool)
    first[_cuts(keys)] = True
    shared = ~first
    shared[:-1] |= ~first[1:]
    out = []
    for kind, chosen in ((_ALONE, ~shared), (_KNOWN, shared & first), (_SETTLED, shared)):
        k, r = keys[chosen], rows[chosen]
        # In order of rows, which then pack well.
        order = np.argsort(r, kind="stable")
        k, r = k[order], r[order]
        # What is settled meets nothing any more: it goes by its row, so that no key gathers it.
        range_ = (r if kind == _SETTLED else k >> np.uint64(32)) % np.uint64(buckets)
        order, parts = _split(range_.astype(np.int64))
        k, r = k[order].astype(np.uint32), r[order]
        out += [(b, kind, _pack(k[x:y]), b"" if kind == _KNOWN else _pack(r[x:y])) for b, x, y in parts]
    return _record(_KEYS_ARROW, out)


def _revealed(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def reveal(group: pa.Table) -> pa.Table:
        kinds = {k: group.filter(pc.equal(group.column("kind"), k)) for k in (_ALONE, _KNOWN, _SETTLED)}
        keys, rows = _bytes(kinds[_ALONE], "keys", np.uint32), _bytes(kinds[_ALONE], "rows", np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        again = np.isin(keys, _bytes(kinds[_KNOWN], "keys", np.uint32))
        same = keys[1:] == keys[:-1]
        again[1:] |= same
        again[:-1] |= same
        settled = kinds[_SETTLED]
        rows = np.concatenate([rows[again], _bytes(settled, "rows", np.uint64)])
        return _back(rows, np.concatenate([keys[again], _bytes(settled, "keys", np.uint32)]), buckets)

    return reveal


def _back(rows: np.ndarray, found: np.ndarray, buckets: int) -> pa.Table:
    """What was found goes back to its rows, packed by bucket of them."""
    order = np.argsort(rows, kind="stable")
    rows, found = rows[order], found[order]
    order, parts = _split((rows % np.uint64(buckets)).astype(np.int64))
    rows, found = rows[order], found[order]
    return pa.table(
        {
            "bucket": pa.array([p[0] for p in parts], pa.int32()),
            "rows": pa.array([_pack(rows[a:b]) for _, a, b in parts], pa.binary()),
            "found": pa.array([_pack(found[a:b]) for _, a, b in parts], pa.binary()),
        }
    )


def _per_row(kind: type, tidy: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def collect(group: pa.Table) -> pa.Table:
        rows, found = _bytes(group, "rows", np.uint64), _bytes(group, "found", kind)
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        edges = _cuts(rows)
        data = [tidy(found[a:b]).tobytes() for a, b in zip(edges, [*edges[1:], len(rows)])]
        return pa.table({"row": pa.array(rows[edges].astype(np.int64)), "found": pa.array(data, pa.binary())})

    return collect


# Windows


def _late_runs(rows: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring windows of a row as one number each: the first window and how many."""
    order = np.lexsort((spots, rows))
    rows, spots = rows[order], spots[order].astype(np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (spots[1:] > spots[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    return rows[first], ((spots[first] << 32) | (spots[last] - spots[first] + 1)).astype(np.uint64)


def _joined_runs(runs: np.ndarray) -> np.ndarray:
    """Runs of one row that touch or overlap, as one; ``runs`` are sorted."""
    begin, stop = (runs >> np.uint64(32)).astype(np.int64), (runs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    reach = np.maximum.accumulate(begin + stop)
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    last = np.append(first[1:], len(runs)) - 1
    return ((begin[first] << 32) | (reach[last] - begin[first])).astype(np.uint64)


def _smallest(classes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry the smallest document of its class; classes count from 0."""
    least = np.full(int(classes.max()) + 1 if len(classes) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, docs)
    return least[classes]


class _Shard:
    """Stretches of candidate windows, gathered from many texts."""

    def __init__(self) -> None:
        self.data, self.size, self.columns = [], 0, []

    def add(self, data: np.ndarray, at: np.ndarray, keys: np.ndarray, docs, rows, spots, width: int) -> None:
        """The windows of ``data`` that start at ``at``; those one apart share their bytes."""
        if not len(at):
            return
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1])))
        last = np.append(first[1:], len(at)) - 1
        begin, sizes = at[first], at[last] - at[first] + width
        stops = np.cumsum(sizes)
        index = np.arange(int(stops[-1])) + np.repeat(begin - (stops - sizes), sizes)
        place = at + np.repeat(stops - sizes - begin, last - first + 1) + self.size
        self.data.append(data[index])
        self.columns.append((place, keys, docs, rows, spots))
        self.size += int(stops[-1])

    def settle(self, buckets: int, width: int) -> pa.RecordBatch:
        """Late windows of the shard, and the stretches of the others for other shards."""
        data = np.concatenate(self.data)
        place, keys, docs, rows, spots = (np.concatenate(c) for c in zip(*self.columns))
        self.__init__()
        order = suffix_array(data)
        klass = np.empty(len(data), np.int64)
        klass[order] = np.cumsum(common_prefixes(data, order) < width) - 1
        late = docs > _smallest(klass[place], docs)
        out = []
        if late.any():
            where, runs = _late_runs(rows[late], spots[late])
            out.append((int(where[0] % np.uint64(buckets)), True, b"", b"", _pack(where), _pack(runs), b"", b""))
        place, keys, docs, rows, spots = (c[~late] for c in (place, keys, docs, rows, spots))
        return _record(_TEXTS_ARROW, out + _stretches(data, place, keys, docs, rows, spots, buckets, width))


def _stretches(data, place, keys, docs, rows, spots, buckets: int, width: int) -> list[tuple]:
    """Neighbouring windows of one key as a row each of their common bytes, packed by range of keys."""
    if not len(place):
        return []
    new = np.ones(len(place), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]) | (spots[1:] != spots[:-1] + 1)
    begun = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    first = np.flatnonzero((np.arange(len(place)) - begun) % STRETCH == 0)
    counts = np.diff(np.append(first, len(place)))
    order, parts = _split(((keys[first] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    first, sizes = first[order], counts[order] + width - 1
    out = []
    for bucket, a, b in parts:
        f, n = first[a:b], sizes[a:b]
        stops = np.cumsum(n)
        index = np.arange(int(stops[-1])) + np.repeat(place[f] - (stops - n), n)
        columns = (keys[f].astype(np.uint32), docs[f], rows[f], spots[f].astype(np.uint32), n.astype(np.uint8), data[index])
        out.append((bucket, False, *map(_pack, columns)))
    return out


def _merged(buckets: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """The stretches of all shards in one range of keys, and what of them is late."""

    def merge(group: pa.Table) -> pa.Table:
        settled = group.filter(group.column("settled"))
        rows, runs = [_bytes(settled, "rows", np.uint64)], [_bytes(settled, "spots", np.uint64)]
        group = group.filter(pc.invert(group.column("settled")))
        if len(group):
            late_rows, late_spots = _late_across(group, width)
            where, found = _late_runs(late_rows, late_spots)
            rows.append(where)
            runs.append(found)
        return _back(np.concatenate(rows), np.concatenate(runs), buckets)

    return merge


def _late_across(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys, docs = _bytes(group, "keys", np.uint32), _bytes(group, "docs", np.int64)
    rows, spots = _bytes(group, "rows", np.uint64), _bytes(group, "spots", np.uint32).astype(np.int64)
    sizes = _bytes(group, "sizes", np.uint8).astype(np.int64)
    data = _bytes(group, "data", np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    column = pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data)]
    )
    # Equal stretches are one: its smallest document stands for it, the others are late in whole.
    same = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    least = _smallest(same, docs)
    whole = docs > least
    counts = sizes - width + 1
    late_rows = [np.repeat(rows[whole], counts[whole])]
    late_spots = [_spread(spots[whole], counts[whole])]
    one = np.unique(same, return_index=True)[1]
    # Only where a key has different stretches can a window be in several of them.
    ranked = one[np.argsort(keys[one], kind="stable")]
    several = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        equal = keys[ranked][1:] == keys[ranked][:-1]
        several[1:] |= equal
        several[:-1] |= equal
    mixed = ranked[several]
    if len(mixed):
        late = _late_windows(data, begins[mixed], counts[mixed], keys[mixed], least[mixed], width)
        owner = np.repeat(np.arange(len(mixed)), counts[mixed])
        offset = _spread(np.zeros(len(mixed), np.int64), counts[mixed])
        # What is late in a stretch is late in all its rows of the smallest document.
        at = np.full(int(same.max()) + 1, -1)
        at[same[mixed]] = np.arange(len(mixed))
        holders = np.flatnonzero(~whole & (at[same] >= 0))
        per = np.bincount(owner[late], minlength=len(mixed))
        begin = np.concatenate([[0], np.cumsum(per)])
        found = offset[late]
        n = per[at[same[holders]]]
        late_rows.append(np.repeat(rows[holders], n))
        late_spots.append(np.repeat(spots[holders], n) + found[_spread(begin[:-1][at[same[holders]]], n)])
    return np.concatenate(late_rows), np.concatenate(late_spots)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each, as many as its count."""
    stops = np.cumsum(counts)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - counts), counts)


def _late_windows(data, begins, counts, keys, docs, width: int) -> np.ndarray:
    """Which windows of the stretches, end to end, are also in one of a smaller document.

    Stretches are in order of keys, and equal windows have equal keys, so blocks of whole keys
    are settled one after the other.
    """
    late = []
    edges = np.append(_cuts(keys), len(keys))
    total = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(edges) - 1:
        limit = total[edges[a]] + _STRINGS // width
        b = max(a + 1, int(np.searchsorted(total[edges], limit, side="right")) - 1)
        x, y = edges[a], edges[b]
        at = _spread(begins[x:y], counts[x:y])
        owners = np.repeat(docs[x:y], counts[x:y])
        strings = np.lib.stride_tricks.sliding_window_view(data, width)[at]
        strings = np.ascontiguousarray(strings).view(np.dtype((np.void, width)))[:, 0]
        distinct = np.unique(strings)
        late.append(owners > _smallest(np.searchsorted(distinct, strings), owners))
        a = b
    return np.concatenate(late)


# The operator


def late_runs(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, found``: packed runs of late windows of ``rows``, which are ``doc_id, text, address``."""
    texts = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    key_ranges, text_ranges = 1 + size // KEY_RANGE, 1 + size // TEXT_RANGE

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part, data, edges, _ in _pieces(batch, "text", width):
                at, keys, owner = _windows(data, edges, width)
                new = _cuts(keys, owner)
                held.append((keys[new], part.column(0).to_numpy().astype(np.uint64)[owner[new]]))
                n += len(new)
                if n > ENTRIES:
                    yield _meeting(*map(np.concatenate, zip(*held)), key_ranges)
                    held, n = [], 0
        if n:
            yield _meeting(*map(np.concatenate, zip(*held)), key_ranges)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for part, data, edges, base in _pieces(batch, "text", width):
                at, keys, owner = _windows(data, edges, width)
                known = [np.frombuffer(k, np.uint32) for k in part.column(3).to_pylist()]
                open_ = np.isin(keys.astype(np.uint32), np.concatenate(known))
                at, keys, owner = at[open_], keys[open_], owner[open_]
                ids = part.column(0).fill_null(0).to_numpy()[owner]
                rows = part.column(1).to_numpy().astype(np.uint64)[owner]
                shard.add(data, at, keys, ids, rows, at - edges[owner] + base, width)
                if shard.size > SHARD:
                    yield shard.settle(text_ranges, width)
        if shard.size:
            yield shard.settle(text_ranges, width)

    revealed = texts.select("address", "text").mapInArrow(meet, _KEYS)
    revealed = revealed.groupBy("bucket").applyInArrow(_revealed(key_ranges), _BACK)
    revealed = revealed.groupBy("bucket").applyInArrow(_per_row(np.uint32, np.unique), _PER_ROW)
    # All rows, as in the last join, so that texts are shuffled once.
    candidates = rows.join(revealed, F.col("address") == F.col("row"))
    candidates = candidates.select(F.col("doc_id").cast("long").alias("doc"), "address", "text", "found")
    late = candidates.mapInArrow(verify, _TEXTS)
    late = late.groupBy("bucket").applyInArrow(_merged(key_ranges, width), _BACK)
    return late.groupBy("bucket").applyInArrow(_per_row(np.uint64, _joined_runs), _PER_ROW)


def _cut(part: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Bytes, spans removed and bytes kept of each row."""
    data, edges = raw(part.column(1))
    cover = np.zeros(len(data) + 1, np.int32)
    for i, runs in enumerate(part.column(2).to_pylist()):
        if runs:
            runs = np.frombuffer(runs, np.uint64)
            begin = (runs >> np.uint64(32)).astype(np.int64) + edges[i]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + (runs & np.uint64(0xFFFFFFFF)).astype(np.int64) + width - 1, -1)
    keep = np.cumsum(cover[:-1]) == 0
    kept_upto = np.concatenate([[0], np.cumsum(keep)])
    change = np.ones(len(data), bool)
    change[1:] = keep[1:] != keep[:-1]
    change[edges[:-1][edges[:-1] < len(data)]] = True
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], len(data))
    gone = ~keep[begin]
    begin, stop = begin[gone], stop[gone]
    first = np.searchsorted(begin, edges)
    base = np.repeat(edges[:-1], np.diff(first))
    spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], names=["start", "stop"])
    kept = pa.Array.from_buffers(
        pa.large_binary(), len(part), [None, pa.py_buffer(kept_upto[edges].astype(np.int64)), pa.py_buffer(data[keep])]
    )
    n_bytes = np.diff(edges)
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(n_bytes),
            pa.array(n_bytes - np.diff(kept_upto[edges])),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans),
            kept.cast(pa.binary()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
    )


def byte_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row of ``docs``.

    ``spans``: ``start, stop`` of each stretch removed, in bytes of the UTF-8 text; ``kept``: the
    other bytes, end to end (a span may begin inside a character).

    A null text counts as empty; texts shorter than a window lose nothing.  Rows with one
    id do not make each other late, whether their texts are equal or not.  A row
    without id is left whole and removes nothing elsewhere.  Ties cannot occur: only a
    smaller id decides.  A very long text is searched in overlapping pieces.  Other
    columns are not read; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _cut(part, width)

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("address"))
    # Rows without id or text have an address too, but no window of theirs was looked at.
    rows = rows.join(late_runs(rows, width), F.col("address") == F.col("row"), "left").select("doc_id", "text", "found")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
    return rows.mapInArrow(cut, schema)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP11_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS win
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS p FROM b WHERE length(h) >= 100)),
late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
runs AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM late)),
spans AS (SELECT doc_id, run, min(p) AS start, max(p) + 50 AS stop FROM runs GROUP BY doc_id, run),
gone AS (
  SELECT doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed,
         list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(
         list_transform(range(0, n_spans + 1), lambda i: substr(h,
           2 * (CASE WHEN i = 0 THEN 0 ELSE stops[i] END) + 1,
           2 * ((CASE WHEN i = n_spans THEN CAST(length(h) / 2 AS BIGINT) ELSE starts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE stops[i] END)))),
         '') END)) AS kept_sha256
FROM b LEFT JOIN gone ON b.doc_id = gone.doc_id
"""
