"""Substring dedup by recompression: remove long passages that an earlier document has.

1. Every document is recompressed (see ``recompression``): names of runs and pairs
   are the same for equal substrings in all documents.  Each window of 13 words picks a
   phrase of symbols that is decided inside it, so equal windows pick equal phrases;
   there is about one phrase to four windows.
2. Phrases meet by name.  Those of at least two documents reveal where repeats may be.
3. Only windows with a revealed phrase meet by their own hash, which verifies them: a
   window is late if its words also start in a document with a smaller id.
4. The words that late windows cover are removed.

One round is used: a name depends on neighbours that lie outside a window's rim, and with
13 words a second round leaves too few symbols decided inside.  Windows in long runs
of one word, where no phrase is decided, stand for themselves.

What meets is packed: a task sends, per range of names, each name once with the
smallest id it saw; copies inside a batch of texts are settled there, so a passage of
a third of all rows is one entry per batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import SLICE_BYTES, read_table, slices, written
from postweave.llm.recompression import anchors, symbols
from postweave.llm.words import mix, window_starts, windows, words
from postweave.session import broadcast_if_small

WIDTH = 13
ROUNDS, PHRASE = 1, 3
#: Text bytes whose names meet in one task, about.
RANGE_BYTES = 1 << 20

_PACKED = "bucket int, settled boolean, keys binary, docs binary, spots binary"
_FOUND = "doc long, keys binary"


def _windows(w, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = window_starts(w.first, width)
    return at, windows(w.hash, width)[at] if len(at) else np.zeros(0, np.uint64)


def _phrases(w, at: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    return anchors(symbols(w.hash, w.owner, ROUNDS), hashes, at, width, PHRASE)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("bucket", "settled", "keys", "docs", "spots")
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def _ranged(keys: np.ndarray, docs: np.ndarray, spots: np.ndarray, buckets: int) -> list[tuple]:
    """A row per range of names."""
    bucket = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    keys, docs, spots, bucket = keys[order], docs[order], spots[order], bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
    return [
        (int(bucket[a]), False, keys[a:b].tobytes(), docs[a:b].tobytes(), spots[a:b].tobytes())
        for a, b in zip(edges, [*edges[1:], len(bucket)])
    ]


def _settled(keys: np.ndarray, docs: np.ndarray, buckets: int) -> list[tuple]:
    """What needs no meeting goes along with some range, another one for each batch."""
    if not len(keys):
        return []
    return [(int(mix(keys[:1])[0] % np.uint64(buckets)), True, keys.tobytes(), docs.tobytes(), b"")]


def _revealing(keys: np.ndarray, docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Phrases of a batch, each with its smallest document; those that several documents of
    the batch have are revealed to all of them here."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    shared = ~first | ~np.append(first[1:], True)
    no_spots = np.zeros(int(first.sum()), np.uint32)
    met = [(*row[:4], b"") for row in _ranged(keys[first], docs[first], no_spots, buckets)]
    return _rows(_settled(keys[shared], docs[shared], buckets) + met)


def _runs(docs: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring windows of a document as runs: first window and length in one number."""
    order = np.lexsort((spots, docs))
    docs, spots = docs[order], spots[order].astype(np.int64)
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (spots[1:] > spots[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    runs = (spots[first] << 32) | (spots[last] - spots[first] + 1) if len(docs) else spots
    return runs.astype(np.uint64), docs[first]


def _verifying(keys: np.ndarray, docs: np.ndarray, spots: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Windows of a batch in their smallest document; in its other documents they are late."""
    order = np.lexsort((docs, keys))
    keys, docs, spots = keys[order], docs[order], spots[order]
    late = docs > _least(keys, docs)
    runs, owners = _runs(docs[late], spots[late])
    return _rows(_settled(runs, owners, buckets) + _ranged(keys[~late], docs[~late], spots[~late], buckets))


def _least(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document of each key, of both sorted by key and document."""
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    return docs[np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))] if len(keys) else docs


def _joined(group: pa.Table, settled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = group.filter(pc.equal(group.column("settled"), settled))
    kinds = (("keys", np.uint64), ("docs", np.int64), ("spots", np.uint32))
    return tuple(np.frombuffer(b"".join(some.column(c).to_pylist()), k) for c, k in kinds)


def _revealed(group: pa.Table) -> pa.Table:
    """Phrases of one range that documents of several batches have."""
    keys, docs, _ = _joined(group, False)
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    again[:-1] |= again[1:]
    known, owners, _ = _joined(group, True)
    return _per_document(np.concatenate([keys[again], known]), np.concatenate([docs[again], owners]))


def _verified(group: pa.Table) -> pa.Table:
    """Runs of windows of one range that also start in a document with a smaller id."""
    keys, docs, spots = _joined(group, False)
    order = np.lexsort((docs, keys))
    keys, docs, spots = keys[order], docs[order], spots[order]
    late = docs > _least(keys, docs)
    runs, owners = _runs(docs[late], spots[late])
    known, known_owners, _ = _joined(group, True)
    return _per_document(np.concatenate([runs, known]), np.concatenate([owners, known_owners]))


def _per_document(keys: np.ndarray, docs: np.ndarray) -> pa.Table:
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    edges = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(docs))
    data = [keys[a:b].tobytes() for a, b in zip(edges, ends)]
    return pa.table({"doc": pa.array(docs[edges]), "keys": pa.array(data, pa.binary())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a document from all ranges, joined where they touch."""
    for batch in batches:
        out = []
        for parts in batch.column(1).to_pylist():
            runs = np.sort(np.frombuffer(b"".join(parts), np.uint64)).astype(np.int64)
            begin, stop = runs >> 32, (runs >> 32) + (runs & 0xFFFFFFFF)
            reach = np.maximum.accumulate(stop)
            first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
            last = np.append(first[1:], len(runs)) - 1
            out.append(((begin[first] << 32) | (reach[last] - begin[first])).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "keys"])


def _gathered(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a column of lists of packed keys, and the row of each."""
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, some in enumerate(parts.to_pylist()):
        for part in some or ():
            found.append(np.frombuffer(part, np.uint64))
            rows.append(np.full(len(found[-1]), i))
    return np.concatenate(found), np.concatenate(rows)


def late_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc, keys``: packed runs of the windows of each document that also start in one with
    a smaller id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // RANGE_BYTES

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 * SLICE_BYTES):
                w = words(part.column(1))
                at, hashes = _windows(w, width)
                ids = part.column(0).to_numpy()[w.owner[at]]
                yield _revealing(_phrases(w, at, hashes, width), ids, buckets)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 * SLICE_BYTES):
                w = words(part.column(1))
                at, hashes = _windows(w, width)
                shared, _ = _gathered(part.column(2))
                open_ = np.isin(_phrases(w, at, hashes, width), shared)
                ids = part.column(0).to_numpy()[w.owner[at]]
                spots = (at - w.first[w.owner[at]]).astype(np.uint32)
                yield _verifying(hashes[open_], ids[open_], spots[open_], buckets)

    phrases = texts.mapInArrow(reveal, _PACKED).groupBy("bucket").applyInArrow(_revealed, _FOUND)
    phrases = phrases.groupBy("doc").agg(F.collect_list("keys").alias("parts"))
    candidates = texts.join(phrases, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "parts")
    late = candidates.mapInArrow(verify, _PACKED).groupBy("bucket").applyInArrow(_verified, _FOUND)
    late = late.groupBy("doc").agg(F.collect_list("keys").alias("parts"))
    return written(late.mapInArrow(_merged, _FOUND), "late")


def _kept(part: pa.RecordBatch, text: int, parts: int, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, removed words and the kept words joined by one space, of each row."""
    w = words(part.column(text))
    runs, rows = _gathered(part.column(parts))
    begin = w.first[rows] + (runs >> np.uint64(32)).astype(np.int64)
    stop = begin + (runs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1 + width
    cover = np.zeros(len(w.hash) + 1, np.int64)
    # Never past the row's own words, whatever text the runs were found in.
    np.add.at(cover, np.minimum(begin, w.first[rows + 1]), 1)
    np.add.at(cover, np.minimum(stop, w.first[rows + 1]), -1)
    keep = np.cumsum(cover[:-1]) == 0
    owner = w.owner
    n = len(w.first) - 1
    removed = np.bincount(owner[~keep], minlength=n)
    start, end, owner = w.start[keep], w.end[keep], owner[keep]
    # Each kept word with one byte more, which becomes the space after it.
    size = end - start + 1
    stop = np.cumsum(size)
    index = np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
    out = w.data[np.minimum(index, max(len(w.data) - 1, 0))] if len(index) else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    final = np.ones(len(owner), bool)
    final[:-1] = owner[1:] != owner[:-1]
    stay = np.ones(len(out), bool)
    stay[stop[final] - 1] = False
    lengths = np.bincount(owner, size, minlength=n).astype(np.int64)
    lengths[lengths > 0] -= 1
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    texts = pa.Array.from_buffers(
        pa.large_string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[stay].tobytes())]
    )
    return w.counts, removed, texts.cast(pa.string())


def _with_late(docs: DataFrame, width: int) -> DataFrame:
    late = late_windows(docs, width).select(F.col("doc").alias("__doc"), F.array("keys").alias("__parts"))
    late, _ = broadcast_if_small(late)
    return docs.join(late, F.col("doc_id").cast("long") == F.col("__doc"), "left")


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row; kept words are joined by one space.

    Null, empty and short texts have no window and lose nothing (null counts as
    empty).  Repeated rows have one id, so none is earlier than another.  A row without
    id is left whole and removes nothing elsewhere.  Other columns are not read; an
    empty table gives no rows.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts, removed, texts = _kept(part, 1, 2, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(removed), texts],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    rows = _with_late(docs.select("doc_id", "text"), width).select("doc_id", "text", "__parts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def strip_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with late passages taken out of ``text``; untouched texts stay as they are."""
    own = docs.columns
    at = own.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, removed, texts = _kept(part, at, len(own), width)
                columns = part.columns[: len(own)]
                columns[at] = pc.if_else(pa.array(removed > 0), texts, columns[at])
                yield pa.RecordBatch.from_arrays(columns, names=own)

    return _with_late(docs, width).select(*own, "__parts").mapInArrow(strip, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13)),
late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM win) WHERE least < doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT q) AS spots FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM late) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: spots IS NULL OR NOT list_contains(spots, i)), lambda i: words[i]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
