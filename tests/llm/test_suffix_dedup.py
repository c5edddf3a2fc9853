"""Byte-level dedup against a plain restatement."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from postweave.llm import suffix_dedup
from tests.llm.helpers import made_up, table


def brute(pairs, width):
    """``doc_id, bytes, removed, spans, kept`` of each ``(doc_id, text)``."""
    least = {}
    for doc, text in pairs:
        data = (text or "").encode()
        if doc is not None:
            for p in range(len(data) - width + 1):
                window = data[p : p + width]
                least[window] = min(least.get(window, doc), doc)
    out = []
    for doc, text in pairs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for p in range(len(data) - width + 1):
                if least[data[p : p + width]] < doc:
                    gone[p : p + width] = b"\1" * width
        spans = []
        for i, g in enumerate(gone):
            if g and (not i or not gone[i - 1]):
                spans.append([i, i])
            if g:
                spans[-1][1] = i + 1
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), len(data) - len(kept), [tuple(s) for s in spans], kept))
    return sorted(out, key=repr)


def found(df, width=50):
    rows = suffix_dedup.byte_repeats(df, width).collect()
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in rows),
        key=repr,
    )


def awkward():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdé ") for _ in range(140))
    texts = [None, "", "a" * 49, "a" * 50, "a" * 400, "ab" * 200, "a" * 51, "\0" * 60, "x" + "\0" * 70 + "y", "é" * 60]
    for k in range(40):
        own = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90)))
        at, size = rng.randrange(80), rng.randrange(40, 100)
        texts.append(own + passage[at : at + size] + own[::-1])
    return texts + ["0" * 30 + passage + "1" * 30, passage * 3, "2" + passage]


@pytest.fixture(scope="module")
def mixed():
    return [t if len(t or "") < 20_000 else t[:9000] for t in made_up(100)] + awkward()


@pytest.mark.parametrize("width", [32, 50, 64])
def test_repeats(spark, mixed, width):
    assert found(table(spark, mixed).repartition(5, "row"), width) == brute(list(enumerate(mixed)), width)


def test_small_ranges_shards_and_pieces(spark, mixed, monkeypatch):
    for name, value in {"KEY_RANGE": 5000, "TEXT_RANGE": 4000, "ENTRIES": 50, "SHARD": 800, "STRETCH": 5, "_STRINGS": 700}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1000)
    frame = table(spark, mixed).repartition(3, "row")
    # What the tasks do, here in this process, where the bounds are changed.
    buckets, width = 7, 50
    meeting, shards = [], []
    shard = suffix_dedup._Shard()
    rows = frame.select("doc_id", "row", "text").where("text is not null").toArrow().to_batches()
    revealed = {}
    for batch in rows:
        for part, data, edges, base in suffix_dedup._pieces(batch, "text", width):
            at, keys, owner = suffix_dedup._windows(data, edges, width)
            meeting.append(suffix_dedup._meeting(keys, part.column(1).to_numpy().astype(np.uint64)[owner], buckets))
    for b in range(buckets):
        group = pa.Table.from_batches(meeting)
        group = group.filter(pc.equal(group.column("bucket"), b))
        back = suffix_dedup._revealed(3)(group)
        for r, k in zip(
            suffix_dedup._bytes(back, "rows", np.uint64).tolist(),
            suffix_dedup._bytes(back, "found", np.uint32).tolist(),
        ):
            revealed.setdefault(r, set()).add(k)
    for batch in rows:
        for part, data, edges, base in suffix_dedup._pieces(batch, "text", width):
            at, keys, owner = suffix_dedup._windows(data, edges, width)
            ids = part.column(0).to_numpy()[owner]
            addresses = part.column(1).to_numpy().astype(np.uint64)[owner]
            low = keys.astype(np.uint32)
            open_ = np.array([int(k) in revealed.get(int(a), ()) for k, a in zip(low, addresses)], bool)
            shard.add(data, at[open_], keys[open_], ids[open_], addresses[open_], (at - edges[owner] + base)[open_], width)
            if shard.size > 800:
                shards.append(shard.settle(buckets, width))
    if shard.size:
        shards.append(shard.settle(buckets, width))
    late = {}
    merge = suffix_dedup._merged(3, width)
    for b in range(buckets):
        group = pa.Table.from_batches(shards)
        back = merge(group.filter(pc.equal(group.column("bucket"), b)))
        for r, run in zip(
            suffix_dedup._bytes(back, "rows", np.uint64).tolist(),
            suffix_dedup._bytes(back, "found", np.uint64).tolist(),
        ):
            late.setdefault(r, set()).update(range(run >> 32, (run >> 32) + (run & 0xFFFFFFFF)))
    least = {}
    for doc, text in enumerate(mixed):
        data = (text or "").encode()
        for p in range(len(data) - width + 1):
            least.setdefault(data[p : p + width], doc)
    for doc, text in enumerate(mixed):
        data = (text or "").encode()
        want = {p for p in range(len(data) - width + 1) if least[data[p : p + width]] < doc}
        assert late.get(doc, set()) == want


def test_repeated_null_and_negative_ids(spark):
    one, other = "the same passage " * 8, "another passage, as long " * 6
    ids = [5, 5, 5, None, None, 3, 9, -2, 9]
    texts = [one, one, other, one, None, other + one, one + other, other[10:], "x" * 60]
    assert found(table(spark, texts, ids)) == brute(list(zip(ids, texts)), 50)


def test_words_whose_polynomial_hashes_agree(spark):
    thue = [0]
    for _ in range(11):
        thue += [1 - t for t in thue]
    one = "".join("ab"[t] for t in thue)
    other = "".join("ba"[t] for t in thue)
    texts = ["<" + one + ">", "<" + other + ">", one]
    assert found(table(spark, texts)) == brute(list(enumerate(texts)), 50)


def test_a_passage_that_many_documents_share(spark):
    passage = "a passage that a third of all documents hold, word for word, and no more. "
    texts = [f"{k * 7919 % 10007} before it {passage if k % 3 == 0 else k * 31} after it {k * 104729}" for k in range(3000)]
    got = found(table(spark, texts).repartition(6, "row"))
    assert got == brute(list(enumerate(texts)), 50)
    assert sum(row[2] > 0 for row in got) >= 999


def test_no_rows(spark, no_docs):
    assert found(no_docs) == []


def test_query(spark, tmp_path, mixed):
    table(spark, mixed).write.parquet(str(tmp_path / "documents.parquet"))
    rows = suffix_dedup.op11_suffix_dedup(spark, str(tmp_path)).collect()
    want = {(d, n, g, len(s), hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute(list(enumerate(mixed)), 50)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(mixed)
