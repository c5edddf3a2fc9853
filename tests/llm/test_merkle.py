"""The Merkle manifest against a plain restatement."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from postweave.llm import merkle
from tests.llm.helpers import table


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return digest(*(field(row[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def climb(nodes, arity):
    """The root, and of each node its siblings ``(before, after)`` up to it."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, covers = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k, members in enumerate(under[a : a + arity]):
                for i in members:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            covers.append([i for members in under[a : a + arity] for i in members])
        nodes, under = above, covers
    return nodes[0], paths


def expected(rows, altered, arity=8):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    trees = []
    for lang in sorted(by_lang, key=low):
        members = sorted(by_lang[lang], key=lambda r: (low(r["doc_id"]), leaf(r, r["text"])))
        leaves = [leaf(r, r["text"]) for r in members]
        trees.append((members, leaves, *climb(leaves, arity)))
    root, upper = climb([t[2] for t in trees], arity) if trees else (None, [])
    out = []
    for (members, leaves, subroot, paths), top in zip(trees, upper):
        for row, own, path in zip(members, leaves, paths):
            steps = path + top
            folded = leaf(row, altered(row))
            for before, after in steps:
                folded = digest(before, folded, after)
            proof = digest(*(b + a for b, a in steps))
            out.append((row["doc_id"], own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def found(df, **options):
    rows = merkle.manifest(df, **options).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifest(spark, texts, arity, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    ids = [None if i % 31 == 0 else i // 2 for i in range(len(texts))]
    docs = table(spark, texts, ids)
    docs = docs.union(docs.limit(20))
    rows = [r.asDict() for r in docs.collect()]
    want = expected(rows, lambda r: r["text"], arity)
    assert found(docs, arity=arity) == want
    assert all(row[-1] for row in want)


def test_tampering_is_found(spark, texts):
    docs = table(spark, texts)
    rows = [r.asDict() for r in docs.collect()]

    def altered(row):
        if row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 3:
            return row["text"]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])

    lowered = F.translate("text", merkle._UPPER, merkle._LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text"))
    got = found(docs, tampered=tampered)
    assert got == expected(rows, altered)
    assert {row[-1] for row in got} == {True, False}


def test_one_and_no_rows(spark, texts, docs, no_docs):
    one = table(spark, ["alone"])
    ((_, own, subroot, root, proof, folded, verified),) = found(one)
    assert own == subroot == root == folded and verified and proof == digest("")
    assert found(no_docs) == []


def test_one_language_and_equal_rows_lie_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    same = table(spark, ["copy"] * 400, [7] * 400).select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
    same = same.withColumn("source", F.lit("a"))
    assert merkle.numbered(same, ["lang", "doc_id"], "ranges").select("part").distinct().count() > 4
    rows = [r.asDict() for r in same.collect()]
    assert found(same) == expected(rows, lambda r: r["text"])
