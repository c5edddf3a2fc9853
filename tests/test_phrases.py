"""Phrase dictionaries of any size against ``dict_replace`` and a plain restatement."""

import random
import time

import pytest
from pyspark.sql import functions as F

from postweave.functions.text import dict_replace
from postweave.operators import phrases
from postweave.operators.phrases import replace_phrases

SCHEMA = "ord LONG, key STRING, value STRING"


def brute(text, pairs):
    if text is None:
        return None
    out, i = [], 0
    while i < len(text):
        for key, value in pairs:
            if text.startswith(key, i):
                out.append(value)
                i += len(key)
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def made_up(seed=1, n=400, keys=300):
    rng = random.Random(seed)
    letters = "abcab ab é가😀"
    word = lambda size: "".join(rng.choice(letters) for _ in range(rng.randrange(1, size)))
    pairs = list({word(9): rng.choice(["", "x", "<" + word(4) + ">", "가"]) for _ in range(keys)}.items())
    rng.shuffle(pairs)
    texts = [None, "", " ", "a", "ab" * 4000] + [word(80) for _ in range(n)]
    return texts, pairs


def rewritten(spark, texts, rows, **options):
    dictionary = spark.createDataFrame(rows, SCHEMA)
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").withColumn("key", F.lit("k")).repartition(3)
    found = replace_phrases(df, "text", dictionary, **options)
    assert found.columns == df.columns
    return [r["text"] for r in sorted(found.collect(), key=lambda r: r["id"])]


@pytest.mark.parametrize("part_bytes", [1 << 30, 4000, 200])
def test_equals_dict_replace(spark, apply, part_bytes):
    texts, pairs = made_up()
    rows = [(i, key, value) for i, (key, value) in enumerate(pairs)]
    got = rewritten(spark, texts, rows, part_bytes=part_bytes)
    assert got == [brute(t, pairs) for t in texts]
    assert got == apply(lambda c: dict_replace(c, pairs), texts)


def test_parts_split_by_first_bytes_and_then_by_hash(spark):
    rows = [(i, f"same start {i}", str(i)) for i in range(300)] + [(1000 + i, f"{i} x", "y") for i in range(300)]
    parts = phrases._parts(phrases._entries(spark.createDataFrame(rows, SCHEMA)), 3000)
    assert any(shares > 1 for _, _, shares in parts) and any(shares == 1 for _, _, shares in parts)
    heads = [head for heads, share, _ in parts if share == 0 for head in heads]
    assert len(heads) == len(set(heads)) > 10
    texts = [f"a same start {i} and {i} x" for i in range(0, 400, 7)]
    pairs = [(key, value) for _, key, value in rows]
    assert rewritten(spark, texts, rows, part_bytes=3000) == [brute(t, pairs) for t in texts]


def test_awkward_entries(spark):
    rows = [(1, "a", "1"), (2, "ab", "2"), (2, "b", "3"), (2, "bc", "4"), (5, "a", "9"), (3, None, "z"), (4, "", "z")]
    rows += [(6, "c", None), (7, "ddd ", ""), (None, "e", "z")]
    texts = ["abc", "bca", "c e", "ddd x", None, ""]
    assert rewritten(spark, texts, rows) == ["13c", "3c1", "c e", "x", None, ""]
    assert rewritten(spark, texts, []) == texts
    assert rewritten(spark, texts[:0] + [None], rows) == [None]


def test_a_dictionary_beyond_every_executor_is_refused(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TOTAL_BYTES", 100)
    with pytest.raises(ValueError, match="beyond"):
        rewritten(spark, ["a"], [(i, f"key {i}", "v") for i in range(9)])


def test_no_rows_and_a_stream(spark, tmp_path):
    dictionary = spark.createDataFrame([(0, "new york", "NY")], SCHEMA)
    df = spark.createDataFrame([(1, "in new york"), (2, None)], "id INT, text STRING")
    assert replace_phrases(df.limit(0), "text", dictionary).count() == 0
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = replace_phrases(stream, "text", dictionary).writeStream.format("parquet")
    query = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "in NY"), (2, None)}


def test_a_million_keys(spark):
    n = 1_000_000
    key = F.concat_ws(" ", F.conv(F.col("id") * 7919 % 1_000_003, 10, 36), F.lit("of"), F.conv(F.col("id"), 10, 36))
    dictionary = spark.range(n).select(F.col("id").alias("ord"), key.alias("key"), F.concat(F.lit("#"), "id").alias("value"))
    picked = spark.range(0, n, 997).select("id", F.concat(F.lit("a "), key, F.lit(" b "), key).alias("text"))
    start = time.time()
    rows = replace_phrases(picked, "text", dictionary, part_bytes=40 << 20).collect()
    assert time.time() - start < 120
    texts = dict(picked.collect())
    table = dict(dictionary.select("key", "value").collect())
    lengths = sorted({len(k) for k in table})
    order = {k: int(v[1:]) for k, v in table.items()}
    for row in rows:
        text, out, i = texts[row["id"]], [], 0
        while i < len(text):
            hits = [text[i : i + m] for m in lengths if text[i : i + m] in table and i + m <= len(text)]
            if hits:
                best = min(hits, key=order.get)
                out.append(table[best])
                i += len(best)
            else:
                out.append(text[i])
                i += 1
        assert row["text"] == "".join(out)
