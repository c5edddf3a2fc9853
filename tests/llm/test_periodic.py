"""Suffix arrays, periodic runs and collapsed texts against plain restatements."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postweave.llm import exact_words, periodic, suffixes
from tests.llm.helpers import table, words_of


def sequences():
    rng = random.Random(3)
    yield []
    yield [0]
    yield [5] * 400
    yield [0, 1] * 90
    yield [int(b) for b in b"mississippi" * 9]
    for size in (1, 2, 3, 60, 700):
        for letters in (1, 2, 3, 50, 10**6):
            yield [rng.randrange(letters) for _ in range(size)]
    block = [rng.randrange(9) for _ in range(90)]
    yield block + [7] + block * 3 + [1] + block


@pytest.mark.parametrize("symbols", list(sequences()), ids=lambda s: f"{len(s)}")
def test_suffix_array_and_prefixes(symbols):
    array = np.array(symbols, np.int64)
    order = suffixes.suffix_array(array)
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    shared = suffixes.common_prefixes(array, order).tolist()
    for r, (i, j) in enumerate(zip(order[:-1], order[1:]), 1):
        k = 0
        while max(i, j) + k < len(symbols) and symbols[i + k] == symbols[j + k]:
            k += 1
        assert shared[r] == k


def test_words_and_joined(texts):
    texts = [*texts, "a b c \x0bd", "é" * 7, "x \n"]
    w = exact_words.word_ids(pa.array(texts))
    spelled = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert spelled == [x for t in texts for x in words_of(t)]
    assert len(set(zip(spelled, w.ids.tolist()))) == len(set(spelled)) == len(set(w.ids.tolist()))
    keep = np.arange(len(w.ids)) % 3 != 1
    kept = [[] for _ in texts]
    for word, doc, stays in zip(spelled, w.owner, keep):
        if stays:
            kept[doc].append(word)
    assert exact_words.joined(w, keep).to_pylist() == [" ".join(k) for k in kept]


def brute_runs(words, least=12):
    """Every stretch, for every period, and what has a smaller period dropped."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items() if n >= max(least, 2 * q))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def awkward():
    rng = random.Random(5)
    texts = [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 300, "x " * 3000, "a b c " * 4 + "a b"]
    texts += [" ".join("abaab" for _ in range(9)), "a b a a b a b a a b a a b a b a a b a b a"]
    for _ in range(60):
        some = [rng.choice("abc" if rng.random() < 0.5 else "abcdefghijklm") for _ in range(rng.randrange(1, 50))]
        for _ in range(rng.randrange(4)):
            at, size = rng.randrange(len(some)), rng.randrange(1, 12)
            some[at:at] = some[at : at + size] * rng.randrange(1, 7)
        texts.append(rng.choice([" ", "\n", "\t "]).join(some))
    line = " ".join(rng.choice("qwertyuiop") + str(i) for i in range(15))
    texts += [line + "\n" + line, line + " " + line + " z " + line + " " + line + " " + line]
    return texts


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs(spark, texts, least):
    texts = [t for t in texts if len(t or "") < 20_000] + awkward()
    rows = periodic.periodic_runs(table(spark, texts), least).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words = words_of(texts[row["doc_id"]])
        want = brute_runs(words, least)
        assert [tuple(r) for r in row["runs"]] == want
        assert row["n_words"] == len(words)
        assert row["collapsed"] == collapsed(words, want)


def test_positions_in_many_chunks(monkeypatch):
    monkeypatch.setattr(periodic.Positions, "CHUNK", 4)
    rng = random.Random(7)
    values = rng.sample(range(1000), 300)
    positions = periodic.Positions(values[0])
    for k, value in enumerate(values[1:], 1):
        known = sorted(values[:k])
        left = max((v for v in known if v < value), default=None)
        right = min((v for v in known if v > value), default=None)
        assert positions.around(value) == (left, right)
        positions.add(value)
    assert list(positions) == sorted(values) and positions.size == 300


def test_a_long_text_of_one_word():
    first = np.array([0, 200_000])
    assert periodic.maximal_runs(np.zeros(200_000, np.int64), first).tolist() == [[0, 0, 200_000, 1]]


def test_empty_table_and_repeated_ids(spark, no_docs):
    assert periodic.periodic_runs(no_docs).collect() == []
    rows = periodic.periodic_runs(table(spark, ["a " * 20, "a " * 30, None], [1, 1, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == [(0, 0), (1, 20), (1, 30)]


def test_query(spark, tmp_path):
    texts = [t for t in awkward() for _ in range(4)]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for row in periodic.op12_periodic_runs(spark, str(tmp_path)).collect():
        words = words_of(texts[row["doc_id"]])
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        assert row["n_runs"] == len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
