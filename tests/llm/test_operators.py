"""Each operator against a plain restatement, on texts with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postweave.llm import (
    hnsw,
    language_id,
    lm_scores,
    mixing,
    near_dedup,
    nearest,
    packing,
    quality_model,
    quality_rules,
    recompression,
    segments,
    substring_dedup,
    token_counts,
)
from postweave.llm import words as words_module
from tests.llm.helpers import by_id, table, words_of


def rows(df):
    return [r.asDict() for r in df.collect()]


# words


def test_words_and_windows(texts):
    w = words_module.words(pa.array(texts))
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert found == [x for t in texts for x in words_of(t)]
    assert w.counts.tolist() == [len(words_of(t)) for t in texts]
    same = {}
    for x, h in zip(found, w.hash.tolist()):
        assert same.setdefault(x, h) == h
    assert len(set(same.values())) == len(same)
    at = words_module.window_starts(w.first, 13)
    spans = [tuple(found[i : i + 13]) for i in at]
    keys = words_module.windows(w.hash, 13)[at].tolist()
    assert len(set(zip(spans, keys))) == len(set(spans)) == len(set(keys))


# 1 near-dedup


def components_of(texts, ids):
    sets = {}
    for i, t in zip(ids, texts):
        some = words_of(t, lower=True)
        sets[i] = {tuple(some[k : k + 5]) for k in range(len(some) - 4)} if len(some) > 4 else {tuple(some)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(spark, docs, texts):
    want, sizes = components_of(texts, range(len(texts)))
    got = rows(near_dedup.near_duplicates(docs))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_chain_with_several_components_in_a_bucket(spark):
    """Each text is near its neighbours only, so one hub cannot settle the buckets."""
    base = [f"c{i}" for i in range(80)]
    texts = [" ".join(base[: 80 - 9 * k] + [f"z{i}" for i in range(80 - 9 * k, 80)]) for k in range(9)]
    texts += [" ".join(base[:40] + [f"u{k}_{i}" for i in range(40)]) for k in range(12)]
    want, _ = components_of(texts, range(len(texts)))
    got = near_dedup.near_duplicates(table(spark, texts))
    assert by_id(got, "component_id") == want
    assert len(set(want.values())) > 2


def test_dropped_near_duplicates(spark, docs, texts):
    want, _ = components_of(texts, range(len(texts)))
    twice = docs.union(docs.where("doc_id in (3, 20)"))
    out = near_dedup.drop_near_duplicates(twice)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept) == sorted({i for i, c in want.items() if i == c})


def test_rows_without_id_are_not_linked(spark):
    docs = table(spark, ["a b c d e f"] * 3, [None, 4, 2])
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {None: (2, False), 4: (2, False), 2: (2, True)} or got[None][1] is False


# 2 language


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language_id.new_network(["a", "b", "c"], h=3)
    data, real = language_id.laid_out([bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (5, 128, 60)])
    target = np.array([0, 2, 1])
    _, grads = language_id.gradients(net, data, real, target)
    for w, g in zip(net.weights, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = language_id.gradients(net, data, real, target)[0]
        w[at] = old - step
        down = language_id.gradients(net, data, real, target)[0]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3 + 0.02 * abs(g[at])


def test_document_probabilities_cover_every_position():
    net = language_id.new_network(["a", "b"])
    text = bytes(range(97, 123)) * 20
    data = np.frombuffer(text, np.uint8)
    got = language_id.document_probabilities(net, data, np.array([0, 0, len(text)]))
    assert got[0].tolist() == [0, 0]
    parts = []
    for at in range(0, len(text), language_id.STRETCH):
        block, _ = language_id.laid_out([text[at : at + language_id.STRETCH]])
        parts.append(language_id.position_probabilities(net, block)[: len(text) - at, :, 0])
    assert np.allclose(got[1], np.concatenate(parts).mean(axis=0), atol=1e-5)
    assert abs(got[1].sum() - 1) < 1e-4


def test_language_held_out_accuracy(spark):
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_without_letters_are_undetermined(spark, docs, texts):
    net = language_id.new_network(["x", "y"])
    got = by_id(language_id.predicted(docs, net), "lang_pred")
    for i, t in enumerate(texts):
        assert (got[i] == "und") == (not any(c.isalpha() for c in t or ""))
    assert set(by_id(language_id.predicted(docs, None), "lang_pred").values()) == {"und"}


# 3 rules


def counts_of(text):
    text = text or ""
    some = words_of(text)
    grams = [tuple(some[k : k + 5]) for k in range(len(some) - 4)]
    seen, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(k, k + 5))
    lines = [line for line in text.split("\n") if words_of(line)]
    return (
        len(some),
        sum(map(len, some)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_rule_counts(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id LONG, quality INT, toxic INT")
    got = rows(quality_rules.judged(docs, labels))
    assert len(got) == len(texts)
    for r in got:
        want = counts_of(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_covering_finds_planted_rules():
    cuts = {"x": [1.0, 2.0, 3.0], "y": [5.0]}
    cells = [
        (prune, (x, y), 50 if x == 3 or (x == 0 and y == 1) else 0, 0 if x == 3 or (x == 0 and y == 1) else 50)
        for prune in (False, True)
        for x in range(4)
        for y in range(2)
    ]
    rules = quality_rules.cover(cells, cuts, 8, 3, 0.9)
    assert {r.conditions for r in rules} == {(("x", ">", 3.0),), (("x", "<=", 1.0), ("y", ">", 5.0))} or len(rules) == 2
    assert quality_rules.cover([], cuts, 8, 3, 0.9) == []


def test_no_labels_leave_the_base_rule(spark, docs):
    labels = spark.createDataFrame([(0, None, None)], "doc_id LONG, quality INT, toxic INT")
    got = rows(quality_rules.judged(docs, labels))
    assert all(r["kept"] != r["base_failed"] for r in got)


# 4 packing


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_is_a_gapless_partition(spark, docs, texts, byte_bpe):
    got = rows(packing.pack_documents(docs))
    own = {}
    for r in got:
        own.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = byte_bpe.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(own[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["length"] for r in mine[1:]] == [2048] * (len(mine) - 1)
        at = 0
        for r in mine:
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_fullest_bins_use_every_piece_once():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 101, 500).tolist())
    left = Counter(counts)
    for n, use in packing.fullest_bins(dict(counts), 100):
        assert n > 0 and sum(length * k for length, k in use) <= 100
        left.subtract({length: n * k for length, k in use})
    assert not any(left.values())
    assert sum(length * n for length, n in packing._fullest([7, 5, 3], {7: 1, 5: 2, 3: 1}, 13)) == 13


def test_packing_of_repeated_rows(spark):
    docs = table(spark, ["a b", "a b", "a b"], [1, 1, None])
    got = rows(packing.pack_documents(docs))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3


ODD = ["", "  a b", "a  b <|endoftext|> c  d", "é à b", "x  y 　 z ", "\n a\tb  \n\n c", "don't 'll <|endoftext|>", " ", "a ", "  b", "á b", "\x1c \x1d x y", "à b à", "日 本 語"]


def test_segments_give_the_tokenizers_ids(byte_bpe, texts):
    some = ODD + [t or "" for t in texts]
    encoder = segments.Encoder(
        public_tokenizers.path("byte_bpe_50k.json"), True, public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    sizes, first, ids = encoder.encode(segments.before_single_spaces(pa.array(some)))
    ends = np.cumsum(segments.per_text(sizes, first))
    for t, a, b in zip(some, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == byte_bpe.encode(t, add_special_tokens=False).ids


# 5 neighbours


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:180] = x[100]
    vectors = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    vectors += [(600, None, 0), (601, [0.0] * 8, 0), (602, [float("nan")] * 8, 0), (603, [], 0), (604, [None] + [1.0] * 7, 0)]
    vectors += [(605, [1.0, 2.0], 0), (620, [2.0, 1.0], 0), (None, [1.0] * 8, 0), vectors[40], vectors[100]]
    table_ = spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<FLOAT>, score INT")
    got = rows(nearest.nearest(table_, table_.where("vec_id % 20 = 0"), shard_rows=150))
    assert {r["query_id"] for r in got} == {*range(0, 600, 20), 620}
    exact, hits = x.astype(float), 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert q not in [r["vec_id"] for r in mine]
        s = exact @ exact[q]
        assert all(abs(s[r["vec_id"]] - r["score"]) < 1e-12 for r in mine)
        order = [int(i) for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        hits += len({r["vec_id"] for r in mine} & set(order))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
    assert hits >= 0.95 * 20 * 30
    # Copies of the query all score alike and come by id.
    copies = [r["vec_id"] for r in got if r["query_id"] == 100 and 100 <= r["vec_id"] < 180]
    assert copies == list(range(101, 101 + len(copies))) and len(copies) > 5
    assert [r["vec_id"] for r in got if r["query_id"] == 620] == [605]
    assert rows(nearest.nearest(table_.limit(0), table_.limit(0))) == []


def test_graph_recall_and_shape():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    graph = hnsw.build(x)
    assert len(graph.nodes) > 1 and graph.neighbours[0].shape == (3000, 2 * hnsw.LINKS)
    q = rng.normal(size=(50, 16))
    found = hnsw.search(graph, q)[:, :10]
    best = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), best.tolist())]) >= 0.95
    assert hnsw.search(hnsw.build(x[:1]), q[:2])[:, 0].tolist() == [0, 0]


# 6 substrings


def stripped(texts, ids):
    seen, out = {}, {}
    split = {i: words_of(t) for i, t in zip(ids, texts)}
    for i, some in split.items():
        for p in range(len(some) - 12):
            key = tuple(some[p : p + 13])
            seen[key] = min(seen.get(key, i), i)
    for i, some in split.items():
        gone = {q for p in range(len(some) - 12) if seen[tuple(some[p : p + 13])] < i for q in range(p, p + 13)}
        out[i] = (len(some), len(gone), " ".join(x for q, x in enumerate(some) if q not in gone))
    return out


def test_substring_dedup(spark, docs, texts):
    want = stripped(texts, range(len(texts)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.repeats(docs).collect()}
    assert got == want
    assert sum(n > 0 for _, n, _ in want.values()) > 10
    out = substring_dedup.strip_repeats(docs)
    assert out.columns == docs.columns
    for i, text in by_id(out, "text").items():
        assert text == (want[i][2] if want[i][1] else texts[i])


def test_packed_exchange_agrees_with_one_batch(texts):
    """What batches settle apart and ranges settle together is what one look at all gives."""
    some = [(i, t) for i, t in enumerate(texts) if t][::-1]
    want = {i: n for i, (_, n, _) in stripped([t for _, t in some], [i for i, _ in some]).items()}
    tables = []
    for at in range(0, len(some), 7):
        part = some[at : at + 7]
        w = words_module.words(pa.array([t for _, t in part]))
        spots, hashes = substring_dedup._windows(w, 13)
        ids = np.array([i for i, _ in part])[w.owner[spots]]
        tables.append(substring_dedup._verifying(hashes, ids, (spots - w.first[w.owner[spots]]).astype(np.uint32), 3))
    whole = pa.Table.from_batches(tables)
    runs = {}
    for bucket in range(3):
        group = whole.filter(pa.compute.equal(whole.column("bucket"), bucket))
        for r in substring_dedup._verified(group).to_pylist():
            runs.setdefault(r["doc"], []).append(r["keys"])
    for i, t in some:
        parts = pa.array([[b"".join(runs[i])]] if i in runs else [None], pa.list_(pa.binary()))
        batch = pa.RecordBatch.from_arrays([pa.array([t]), parts], names=["t", "p"])
        assert substring_dedup._kept(batch, 0, 1, 13)[1][0] == want[i]


def test_equal_windows_pick_equal_phrases(texts):
    w = words_module.words(pa.array([t or "" for t in texts]))
    at, hashes = substring_dedup._windows(w, 13)
    for rounds, phrase in ((1, 3), (2, 1), (2, 2)):
        picked = recompression.anchors(recompression.symbols(w.hash, w.owner, rounds), hashes, at, 13, phrase)
        known = {}
        for h, a in zip(hashes.tolist(), picked.tolist()):
            assert known.setdefault(h, a) == a
        assert len(set(picked.tolist())) < len(set(hashes.tolist()))


# 7 token counts


def test_token_counts(spark, docs, texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), huge=3000).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


@pytest.mark.parametrize("chunk, overlap", [(50, 4), (333, 16), (5000, 64)])
def test_overlaps_resynchronise(texts, chunk, overlap):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in [" ".join(t or "" for t in texts)[:30_000], "y" * 1000 + " b " * 50, "\n".join(ODD) * 20, "ab" * 700]:
        parts = list(token_counts.spliced(text, model, chunk, overlap))
        assert [i for _, ids in parts for i in ids] == model.encode(text, add_special_tokens=False).ids


# 8 language model


def test_base_scores(spark, docs, texts):
    got = {r["doc_id"]: r for r in lm_scores.scored(docs).collect()}
    tokens = {i: words_of(t, lower=True) + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(x for i, some in tokens.items() if not held[i] for x in some)
    n, v = sum(counts.values()), len(counts)
    for i, some in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in some)
        assert abs(r["base_score"] - base) < 1e-8 * max(1, abs(base))
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(some), n, held[i])
        assert r["n_known"] == sum(counts[x] > 0 for x in some)
        assert r["score"] < 0


def test_class_probabilities_sum_to_one():
    shares = np.full(lm_scores.CLASSES, 1 / lm_scores.CLASSES)
    model = lm_scores.new_model(shares)
    before = np.zeros((lm_scores.CONTEXT, lm_scores.CLASSES), int)
    p = 10 ** lm_scores.class_log10(model, model.tables(), before, np.arange(lm_scores.CLASSES))
    assert abs(p.sum() - 1) < 1e-4


def test_training_learns_an_order():
    rng = np.random.default_rng(1)
    tokens = np.tile([1, 2, 3, 4], 4000)
    shares = np.full(lm_scores.CLASSES, 1e-4)
    shares[1:5] = 0.25
    trainer = lm_scores.Trainer(lm_scores.new_model(shares / shares.sum()), shares / shares.sum())
    for _ in range(6):
        trainer.learn(tokens, np.zeros(len(tokens), int))
    m = trainer.model
    p = lm_scores.class_log10(m, m.tables(), lm_scores.contexts(tokens, np.zeros(len(tokens), int))[:, 8:12], tokens[8:12])
    assert (p > math.log10(0.5)).all(), rng


def test_words_of_one_class_have_their_own_contexts_and_probabilities():
    # Four words of one shared class; the second and fourth tell what follows.
    k, c = lm_scores.CLASSES, lm_scores.FREQUENT + 5
    trees = lm_scores.leaves(np.full(4, c), np.full(4, 4000), np.zeros(k))
    shares = np.full(k, 1e-4)
    shares[c] = 1
    shares /= shares.sum()
    trainer = lm_scores.Trainer(lm_scores.new_model(shares, trees), shares)
    tokens = np.tile(k + np.array([0, 1, 2, 3]), 4000)
    for _ in range(6):
        trainer.learn(tokens, np.zeros(len(tokens), int))
    m = trainer.model
    before = lm_scores.contexts(tokens, np.zeros(len(tokens), int))[:, 8:12]
    assert (lm_scores.class_log10(m, m.tables(), before, tokens[8:12]) > math.log10(0.5)).all()
    every = np.arange(k + 4)
    for b in before.T:
        p = 10 ** lm_scores.class_log10(m, m.tables(), np.repeat(b[:, None], len(every), 1), every)
        assert abs(p.sum() - 1) < 1e-4
    again = m.with_rows(m.rows())
    assert all(np.array_equal(getattr(m, x), getattr(again, x)) for x in ("seen", "maps", "said", "bias", "turned", "odds"))


def test_all_words_of_two_counts_are_symbols(spark):
    some = [f"ab{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(some + [f"once{i}"])) for i in range(40)], "doc_id LONG, text STRING")
    counts = lm_scores.written(lm_scores.word_counts(docs), "word_counts")
    voc = lm_scores.vocabulary(counts)
    w = words_module.words(pa.array([" ".join(some), "once1 ab0"]), lower=True)
    found = voc.symbols(w)
    assert len(set(found[:300].tolist())) == 300
    assert lm_scores.FREQUENT <= found[300] < lm_scores.END and found[301] == found[0]
    assert voc.rest_counts.sum() - voc.class_counts[: lm_scores.FREQUENT].sum() - voc.class_counts[lm_scores.END] == 40


# 9 quality


def test_discriminant_separates(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(texts))], "doc_id LONG, quality INT, toxic INT")
    got = rows(quality_model.scored(docs, labels))
    assert len(got) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (400, 3)), rng.normal(3, 0.5, (200, 3))
    scatter = [np.cov(x.T) * (len(x) - 1) for x in (bad, good)]
    model = quality_model.discriminant(np.array([bad.mean(0), good.mean(0)]), scatter, [200, 400], 0.1, 0.02)
    assert (model.scores(good) > 0.5).mean() > 0.97 and (model.scores(bad) < 0.5).mean() > 0.97


def test_quality_held_out(spark):
    from tests.conftest import SMALL

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.scored(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    kept = quality_model.keep_good(docs, labels)
    want = {r["doc_id"] for r in quality_model.scored(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_features_of_odd_texts(texts):
    x = quality_model.features(pa.array([*texts, *ODD]))
    assert np.isfinite(x).all() and x.shape[1] == len(quality_model.FEATURES)


# 10 mixing


def test_mix_comes_near_its_targets(spark, docs, texts):
    got = rows(mixing.mixed(docs))
    again = rows(mixing.mixed(docs.repartition(3)))
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = {i: len(words_of(t)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    total, largest = sum(sizes.values()), max(sizes.values())
    per = {}
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        at = per.setdefault(["a", "b", "c", None][r["doc_id"] % 4], [0, r["target"], r["source_size"]])
        at[0] += r["taken"]
    open_, left, weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5])), float(total), {}
    while True:
        weight = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / weight > 3 * per[s][2]] if weight else []
        if not over:
            weights |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in over:
            weights[s] = 3.0 * per[s][2]
        left -= sum(weights[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    for s, (taken, target, _) in per.items():
        assert abs(target - weights[s]) < 1e-6 * total
        assert abs(taken - target) <= largest
    assert sum(r["taken"] for r in got) <= total


def test_mixture_serves_what_the_mix_takes(spark, docs):
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mixing.mixed(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in taken.items() if n})


# all of them on no rows


def test_no_rows(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (
        near_dedup.near_duplicates(no_docs),
        near_dedup.drop_near_duplicates(no_docs),
        language_id.identified(no_docs),
        quality_rules.judged(no_docs, labels),
        packing.pack_documents(no_docs),
        substring_dedup.repeats(no_docs),
        token_counts.token_counts(no_docs, path),
        lm_scores.scored(no_docs),
        quality_model.scored(no_docs, labels),
        mixing.mixed(no_docs),
        mixing.mixture(no_docs),
    ):
        assert df.count() == 0


def test_kept_digest(spark, docs, texts):
    from pyspark.sql import functions as F

    got = substring_dedup.repeats(docs).select("doc_id", F.sha2("kept_text", 256).alias("d")).collect()
    want = stripped(texts, range(len(texts)))
    assert all(r["d"] == hashlib.sha256(want[r["doc_id"]][2].encode()).hexdigest() for r in got)


def test_scores_do_not_depend_on_the_layout(spark, docs, texts, tmp_path):
    scores = []
    for parts in (1, 8, 64):
        path = str(tmp_path / str(parts))
        docs.select("doc_id", "text").repartition(parts).write.parquet(path)
        scores.append({r["doc_id"]: r["score"] for r in lm_scores.scored(spark.read.parquet(path)).collect()})
    assert len(scores[0]) == len(texts)
    for other in scores[1:]:
        for i, score in scores[0].items():
            assert math.isclose(other[i], score, rel_tol=1e-9)


def test_shares_hold_each_text_once_with_its_copies(spark):
    texts = ["one", "two", "two", None, "", "three"] * 30 + ["hot"] * 200
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7).fillna("")
    dealt = lm_scores.dealt(docs, 3)
    assert dealt.rdd.getNumPartitions() == 3
    assert {(r["text"], r["n"]) for r in dealt.collect()} == set(Counter(t or "" for t in texts).items())


def test_equal_rows_of_a_batch_are_counted_once():
    before = np.array([[1, 1, 2, 1, 1], [3, 3, 3, 3, 3], [0, 0, 0, 0, 0]])
    first, rows = lm_scores._alike(before, np.array([5, 5, 5, 6, 5]))
    groups = [sorted(g.tolist()) for g in np.split(rows, first[1:])]
    assert sorted(groups) == [[0, 1, 4], [2], [3]]
    first, rows = lm_scores._alike(np.zeros((3, 40), int), np.zeros(40, int))
    assert np.diff(np.append(first, 40)).tolist() == [16, 16, 8]


# Words that a polynomial hash modulo 2**64 cannot tell apart.


def thue_morse():
    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_regular_words_are_told_apart(spark):
    one, other = thue_morse()
    w = words_module.words(pa.array([one, other, one[:1024], other[:1024]]))
    assert len(set(w.hash.tolist())) == 4
    tail = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {tail}"), (4, f"{other} {tail}")], "doc_id long, text string")
    linked = near_dedup.near_duplicates(docs).collect()
    assert all(r["kept"] for r in linked if r["doc_id"] < 3)
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeats(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0}
    counts = lm_scores.word_counts(docs).where(f"class <> {lm_scores.END}")
    assert counts.count() == 14


@pytest.mark.parametrize("ids, name", [(False, "word_bpe_49k.json"), (True, "byte_bpe_50k.json")])
def test_regular_words_have_their_own_ids(ids, name):
    path = public_tokenizers.path(name)
    cut = segments.before_single_spaces if ids else segments.at_white_space
    texts = [f"x {t} y" for t in thue_morse()]
    sizes, first, found = segments.Encoder(path, ids).encode(cut(pa.array(texts)))
    want = [segments.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert segments.per_text(sizes, first).tolist() == [len(x) for x in want]
    if ids:
        assert found.tolist() == want[0] + want[1]
