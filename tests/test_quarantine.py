"""Lines of JSON: accepted and rejected ones are the input."""

import json
import random

from postweave.sources.quarantine import accepted, checked_posts, read_lines, reason_counts, rejected


def expected(line):
    """Reasons of a line by Python's parser."""
    try:
        pairs = json.loads(line, object_pairs_hook=lambda p: p) if line else None
    except ValueError:
        return ["malformed"]
    if pairs is None and line != "null":
        return ["malformed"]
    if not line.lstrip().startswith("{"):
        return ["not an object"]
    if len({k for k, _ in pairs}) < len(pairs):
        return ["malformed"]
    item, out = dict(pairs), []
    for name, kind, label in (("id", int, "an integer"), ("nickname", str, "text"), ("comment", str, "text")):
        if name not in item:
            out.append(f"{name}: missing")
        elif item[name] is None:
            out.append(f"{name}: null")
        elif type(item[name]) is not kind:
            out.append(f"{name}: not {label}")
    return out


def lines():
    rng = random.Random(2)
    values = [None, True, 5, -3, 2.5, "", "가 \n", "x" * 5000, ["a"], {"b": 1}, 10**18]
    out = [None, "", " ", "null", "3", '"text"', "[]", "{}", "{", '{"id": 1,}', '{"id": 1, "id": 2, "nickname": "a", "comment": "b"}']
    for _ in range(300):
        item = {name: rng.choice(values) for name in ("id", "nickname", "comment", "more") if rng.random() < 0.8}
        text = json.dumps(item, ensure_ascii=rng.random() < 0.5)
        out.append(text if rng.random() < 0.9 else text[: rng.randrange(len(text))])
    return out + [json.dumps({"id": k, "nickname": "n", "comment": "c"}) for k in range(20)]


def test_every_line_is_accepted_or_rejected_with_its_reasons(spark):
    some = lines()
    df = spark.createDataFrame(list(enumerate(some)), "n INT, value STRING")
    checked = checked_posts(df)
    found = {r["n"]: r["reasons"] for r in checked.collect()}
    assert found == {n: expected(line) for n, line in enumerate(some)}
    good, bad = accepted(checked), rejected(checked)
    assert good.columns == ["id", "nickname", "comment"] and bad.columns == ["n", "value", "reasons"]
    assert good.count() + bad.count() == len(some) and good.count() >= 20
    want = [json.loads(line) for line in some if not expected(line)]
    assert sorted(map(tuple, good.collect())) == sorted((w["id"], w["nickname"], w["comment"]) for w in want)
    kept = {r["n"]: r["value"] for r in bad.collect()}
    assert kept == {n: line for n, line in enumerate(some) if expected(line)}
    counts = {r["reason"]: r["n"] for r in reason_counts(checked).collect()}
    assert sum(counts.values()) == sum(len(expected(line)) for line in some)


def test_no_lines_and_a_stream(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text('{"id": 1, "nickname": "n", "comment": "c"}\n{"id": 2}\n')
    assert read_lines(spark, str(source)).columns == ["value", "path"]
    table = checked_posts(read_lines(spark, str(source)))
    assert table.limit(0).count() == 0
    stream = checked_posts(spark.readStream.text(str(source)))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    streamed = spark.read.parquet(sink).select("id", "reasons").collect()
    assert sorted(map(repr, streamed)) == sorted(map(repr, table.select("id", "reasons").collect()))
