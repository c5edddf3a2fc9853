"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks with offsets.  Two neighbours are
spliced where white space lies in their overlap and both encodings have an edge
there: the tokenizer drops white space and never joins characters across it, so
what follows is encoded alike in both, which the ids after the splice confirm.
Where no such place is found the overlap is widened, up to one chunk.

Other texts are encoded by their distinct stretches between white space, the
same stable boundaries (see ``segments``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from postweave.llm import segments
from postweave.llm.common import read_table, slices

#: Texts above this many characters are encoded in chunks.
HUGE = 200_000
CHUNK = 100_000
OVERLAP = 256
#: Ids that must agree after a splice.
AGREE = 8

_WHITE = " \t\n\v\f\r"


def spliced(text: str, model, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, list[int]]]:
    """The ids of ``text`` as ``(start, ids)`` runs, a run per chunk."""
    begin, done = 0, 0
    while True:
        end, wide = min(len(text), begin + chunk), overlap
        ahead = model.encode(text[begin:end], add_special_tokens=False)
        splice = None
        while end < len(text) and splice is None:
            # The neighbour, only as far as is needed to compare.
            left = max(done + 1, end - wide)
            behind = model.encode(text[left : end + wide], add_special_tokens=False)
            splice = _stable(text, ahead, begin, behind, left, end)
            if splice is None and left == done + 1:
                # No stable place in the whole chunk: a longer chunk.
                end, wide = min(len(text), end + max(wide, chunk)), overlap
                ahead = model.encode(text[begin:end], add_special_tokens=False)
            elif splice is None:
                wide *= 2
        upto = len(text) if splice is None else splice
        yield done, [i for i, (a, b) in zip(ahead.ids, ahead.offsets) if done <= begin + a and begin + b <= upto]
        if splice is None:
            return
        begin = done = splice


def _stable(text, ahead, begin, behind, left, end) -> int | None:
    """The last white space before ``end`` where both encodings have an edge and agree after it."""
    mine = {begin + a: k for k, (a, _) in enumerate(ahead.offsets)}
    for k, (a, _) in reversed(list(enumerate(behind.offsets))):
        place = left + a
        if place >= end or place == 0 or text[place - 1] not in _WHITE or place not in mine:
            continue
        first = ahead.ids[mine[place] :]
        # The chunk's last word may be cut short: it is compared only if whole.
        whole = [i for i, (_, b) in zip(first, ahead.offsets[mine[place] :]) if begin + b < end]
        sure = whole[: max(0, len(whole) - AGREE)] or whole[:0]
        if behind.ids[k : k + min(len(sure), AGREE)] == sure[:AGREE]:
            return place
    return None


def count_huge(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return sum(len(ids) for _, ids in spliced(text, segments.tokenizer(path), chunk, overlap))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, huge: int = HUGE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    each; other columns are not read; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _counted(part, path, limit, huge)

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def _counted(part: pa.RecordBatch, path: str, limit: int, huge: int) -> pa.RecordBatch:
    texts = part.column(1).fill_null("")
    n_bytes = pc.binary_length(texts.cast(pa.large_binary())).to_numpy(zero_copy_only=False)
    long = n_bytes > huge
    short = pc.if_else(pa.array(~long), texts, pa.scalar("", texts.type))
    sizes, first, _ = segments.encoder(path, False).encode(segments.at_white_space(short))
    n_tokens = segments.per_text(sizes, first)
    for i in np.flatnonzero(long):
        n_tokens[i] = count_huge(texts[int(i)].as_py(), path)
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(n_bytes.astype(np.int64)), pa.array(n_tokens), pa.array(n_tokens > limit)],
        names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
