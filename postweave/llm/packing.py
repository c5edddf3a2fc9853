"""Best-fit packing by minimum bin slack.

Every bin is opened with the longest piece left and filled by a subset-sum
search: a bitset holds the sums that the available lengths can reach, and the
fullest one is taken.  Pieces of one length are alike, so the search runs on the
histogram of lengths, at most ``capacity`` counters whatever the input, and a
combination is used as often as its lengths last.  What it yields is a bounded
table of length segments; pieces find their place in it by their rank among the
pieces of their length, with no group in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.llm import segments
from postweave.llm.common import read_table, slices, written

CAPACITY = 2048
#: Pieces of one length that are ranked in one task, about.
RANKED = 10_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(bins, [(length, pieces per bin)])`` until nothing is left.

    Each entry opens with the longest length; the rest is the fullest feasible
    combination of the lengths that remain.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        use = {longest: 1}
        for length, n in _fullest(lengths, left, capacity - longest):
            use[length] = use.get(length, 0) + n
        left[longest] += 1
        bins = min(left[length] // n for length, n in use.items())
        for length, n in use.items():
            left[length] -= bins * n
        out.append((bins, sorted(use.items(), reverse=True)))
        lengths = [x for x in lengths if left[x]]
    return out


def _fullest(lengths: list[int], left: dict[int, int], slack: int) -> list[tuple[int, int]]:
    """The combination with the largest sum up to ``slack``."""
    mask, reached = (1 << (slack + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, pieces, sums reached before
    for length in lengths:
        if length > slack:
            continue
        n, many = min(left[length], slack // length), 1
        while n > 0 and not reached >> slack & 1:
            many = min(many, n)
            steps.append((length, many, reached))
            reached |= (reached << (length * many)) & mask
            n, many = n - many, many * 2
        if reached >> slack & 1:
            break
    total, taken = reached.bit_length() - 1, []
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            taken.append((length, many))
            total -= length * many
    return taken


def segments_of(bins: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Per length: ranks from ``lo`` on fill ``per_bin`` places of each bin from ``bin`` on, at ``at``."""
    rows, seen, first = [], {}, 0
    for n, use in bins:
        offset = 0
        for length, per_bin in use:
            lo = seen.get(length, 0)
            seen[length] = lo + n * per_bin
            rows.append((length, lo, lo + n * per_bin, per_bin, first, offset))
            offset += per_bin * length
        first += n
    names = ["length", "lo", "hi", "per_bin", "bin", "at"]
    return pd.DataFrame(rows, columns=names, dtype="int64")


def pieces(docs: DataFrame, path: str, ranks: str | None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every row: a document's ids and a closing 0, cut from its end
    into ``capacity`` tokens, so that only the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _cut(part, path, ranks, capacity)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def _cut(part: pa.RecordBatch, path: str, ranks: str | None, capacity: int) -> pa.RecordBatch:
    texts = part.column(1).fill_null("")
    encoded = segments.encoder(path, True, ranks).encode(segments.before_single_spaces(texts))
    sizes, first, ids = encoded
    n = segments.per_text(sizes, first)
    # Room for each document's closing 0.
    ids = np.insert(ids, np.cumsum(n), 0).astype("<u4") if len(n) else ids.astype("<u4")
    n = n + 1
    begin = np.cumsum(n) - n
    per_doc = -(-n // capacity)
    owner = np.repeat(np.arange(len(n)), per_doc)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    stop = n[owner] - (per_doc[owner] - 1 - piece) * capacity
    start = np.maximum(stop - capacity, 0)
    data = ids.tobytes()
    crc = [
        zlib.crc32(data[4 * a : 4 * b])
        for a, b in zip((begin[owner] + start).tolist(), (begin[owner] + stop).tolist())
    ]
    return pa.RecordBatch.from_arrays(
        [
            part.column(0).take(pa.array(owner)),
            pa.array(piece.astype(np.int32)),
            pa.array(start),
            pa.array(stop - start),
            pa.array(np.asarray(crc, np.int64)),
        ],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice: pass a written table.  Every length must be from 1
    to ``capacity``.  Repeated rows get a place each; no rows give no rows.
    """
    spark = pieces.sparkSession
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = segments_of(fullest_bins(counted, capacity))
    if table.empty:
        return pieces.withColumns(
            {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}
        )
    own = [c for c in pieces.columns if c != "length"]
    placed = _ranked(pieces, own, max(1, sum(counted.values()) // ranked))
    # At most a few rows per length and combination: bounded by the capacity alone.
    table = F.broadcast(spark.createDataFrame(table).withColumnRenamed("length", "l"))
    step = F.col("r") - F.col("lo")
    return (
        placed.join(table, (F.col("length") == F.col("l")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
        .withColumn("sequence_id", F.col("bin") + F.floor(step / F.col("per_bin")))
        .withColumn("offset", F.col("at") + step % F.col("per_bin") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def _ranked(pieces: DataFrame, own: list[str], shares: int) -> DataFrame:
    """Add ``r``, the rank from 0 among pieces of the same length: shares of a length are
    ranked apart and moved behind the shares before them."""
    share = F.pmod(F.xxhash64(*own), F.lit(shares))
    dealt = pieces.withColumn("share", share)
    cells = dealt.groupBy("length", "share").count()
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col("length").alias("cl"),
        F.col("share").alias("cs"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("moved"),
    )
    inside = Window.partitionBy("length", "share").orderBy(*own)
    return (
        dealt.withColumn("i", F.row_number().over(inside) - 1)
        .join(cells, (F.col("length") == F.col("cl")) & (F.col("share") == F.col("cs")))
        .withColumn("r", F.col("i") + F.col("moved"))
    )


def pack_documents(
    docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Null and empty texts are one closing token; very long ones become full pieces
    and one shorter first piece; repeated rows are packed each; only ``doc_id``
    and ``text`` are read; an empty table gives no rows.
    """
    if path is None:
        path = public_tokenizers.path("byte_bpe_50k.json")
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(written(pieces(docs, path, ranks, capacity), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
