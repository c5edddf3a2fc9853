"""Near-duplicates by a multi-index Hamming join of b-bit min-hash signatures.

A set of word shingles has 84 min-hashes of 16 bits, in 14 chunks of six.  Two
signatures that differ in at most 27 places (``14 * (1 + 1) - 1``) differ in at
most one place of some chunk, by pigeonhole.  Enumerating the allowed errors of
a chunk, that is its six forms with one place left open, therefore gives every
such pair a common key.  At the threshold itself a pair escapes all 14 chunks
with probability 0.47 ** 14, about 2 in 100,000, and more alike pairs far less.

Equal sets are one class before any key is made.  Among the class
representatives of a bucket no pairs are enumerated at first: all are compared
with one hub and links become components.  Only in a bucket that still holds
several components are pairs across them compared, by longer sketches inside the
join.  Every pair with a common key ends up compared or in one component, so
components lose no link.  Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import read_table, slices, written
from postweave.llm.components import components
from postweave.llm.shingles import WIDTH, shingle_sets, signatures
from postweave.llm.words import mix
from postweave.session import broadcast_if_small

CHUNKS, PLACES = 14, 6
#: Bits of the longer sketches that are made where one hub did not settle a bucket.
SKETCH = 2048

_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, signature binary"


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Set size, set identity (128 bits) and signature of every row; an empty set has no
    identity and no signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _signed(part, width)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, _SIGNED)


def _signed(part: pa.RecordBatch, width: int) -> pa.RecordBatch:
    hashes, edges = shingle_sets(part.column(1), width)
    n = np.diff(edges)
    full = n > 0
    row = np.cumsum(full) - 1
    signs = signatures(hashes, edges, CHUNKS * PLACES)
    begins = edges[:-1][full]
    if len(begins):
        s1 = np.add.reduceat(mix(hashes), begins)
        s2 = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begins)
    else:
        s1 = s2 = np.zeros(0, np.uint64)
    take = pa.array(row, mask=~full)
    packed = pa.array([r.tobytes() for r in signs], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(n.astype(np.int64)),
            pa.array(s1.view(np.int64)).take(take),
            pa.array(s2.view(np.int64)).take(take),
            packed.take(take),
        ],
        names=["doc_id", "n_shingles", "s1", "s2", "signature"],
    )


def keys(sets: DataFrame) -> DataFrame:
    """``key, id``: each chunk of each signature with each one of its places left open."""

    def enumerate_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            signs = signs.reshape(-1, CHUNKS, PLACES).astype(np.uint64)
            found = []
            for chunk in range(CHUNKS):
                for open_place in range(PLACES):
                    key = np.full(len(signs), chunk * PLACES + open_place + 1, np.uint64)
                    for place in range(PLACES):
                        if place != open_place:
                            key = mix(key * np.uint64(31) + signs[:, chunk, place])
                    found.append(key)
            ids = pa.concat_arrays([batch.column(0)] * len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), ids], names=["key", "id"]
            )

    return sets.select("id", "signature").mapInArrow(enumerate_errors, "key long, id long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets have ``100 * intersection >= percent * union``."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ends, _ = broadcast_if_small(written(ends, "ends"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ends, F.col("doc_id") == F.col("id"), "left_semi")

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, edges = shingle_sets(part.column(1), width)
                data = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(data, pa.binary())], names=["id", "shingles"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sets = written(texts.mapInArrow(collect_sets, "id long, shingles binary"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A component is named by its smallest ``doc_id``, which is the one kept.  Rows
    with null or empty texts, or without words, have no shingles and are linked
    with nothing.  Repeated rows share a class (an id should name one text).  A
    row without id cannot be linked and is not kept.  Other columns are not read;
    an empty table gives no rows.
    """
    rows = written(signed(docs, width), "signed")
    grouped = rows.where("s1 is not null and doc_id is not null").groupBy("s1", "s2")
    sets = written(
        grouped.agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")), "classes"
    )
    found = linked(docs, sets, percent, width)
    named = sets.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("component", "id").alias("component_id")
    )
    joined = rows.join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def linked(docs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """``node, component`` of the class representatives that have a link."""
    every = keys(sets)
    shared = every.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("hub"))
    shared = shared.where("n > 1")
    members = written(every.join(shared, F.col("key") == F.col("k")).select("key", "id", "hub"), "keys")
    spokes = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    links = written(confirmed(written(spokes.distinct(), "spokes"), docs, percent, width), "links")
    named = written(components(links), "named")
    spread = members.join(named, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    # Keys whose members are not yet all in one component.
    mixed = spread.groupBy(F.col("key").alias("k")).agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = mixed.where("low <> high").select("k")
    spread = written(spread.join(mixed, F.col("key") == F.col("k")).drop("k"), "open")
    pairs = written(_across(spread, docs, percent, width), "pairs")
    more = confirmed(pairs, docs, percent, width)
    return components(links.union(more))


def _across(spread: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``a, b``: pairs of one key in two components, unless their sketches or sizes rule a
    link out.

    A sketch is one bit of each of 2048 min-hashes, compared by native bit counts
    inside the join, so only what passes becomes a row; a pair is passed on at the
    first key it shares.
    """
    own = spread.groupBy(F.col("id").alias("own")).agg(F.collect_list("key").alias("keys"))
    few, _ = broadcast_if_small(written(own.select("own"), "unsettled"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(few, F.col("doc_id") == F.col("own"), "left_semi")
    words = SKETCH // 64
    schema = "sid long, size long, " + ", ".join(f"w{i} long" for i in range(words))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, edges = shingle_sets(part.column(1), width)
                full = np.diff(edges) > 0
                bits = (signatures(hashes, edges, SKETCH) & 1).astype(np.uint8)
                packed = np.packbits(bits, axis=1).view(np.int64).reshape(-1, words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(full)), pa.array(np.diff(edges)[full])]
                    + [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(words)],
                    names=["sid", "size", *(f"w{i}" for i in range(words))],
                )

    sketched = texts.mapInArrow(sketch, schema).dropDuplicates(["sid"])
    own = own.join(sketched, F.col("own") == F.col("sid")).drop("sid")
    rows = written(spread.join(own, F.col("id") == F.col("own")).drop("own"), "sketched")
    x, y = rows.alias("x"), rows.alias("y")
    apart = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(words)), F.lit(0))
    alike = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    sizes = F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent
    condition = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
    condition &= (F.col("x.component") != F.col("y.component")) & sizes & (apart <= _apart(percent)) & alike
    return x.join(y, condition).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _apart(percent: int) -> int:
    """Bits in which sketches of sets at the threshold differ, at 5.5 standard deviations."""
    p = (1 - percent / 100) / 2
    return int(SKETCH * p + 5.5 * (SKETCH * p * (1 - p)) ** 0.5)


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id.

    Unlike texts under one id are judged apart, so none is lost.  Rows without an id stay as
    they are; so does one row each of null or empty text for every id.  Other columns may
    have any names but those that begin with ``__near_``.
    """
    keyed = _by_text(docs)
    texts = keyed.where(f"{_KEY} is not null").select(F.col(_KEY).alias("doc_id"), "text")
    judged = written(near_duplicates(texts, percent), "judged")
    repeated = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    repeated = written(repeated.where("n > 1 or not kept"), "repeated")
    marked = repeated.select(F.col("doc_id").alias("__near_marked"), F.col("kept").alias("__near_stays"))
    marked, _ = broadcast_if_small(marked)
    mine = F.col(_KEY) == F.col("__near_marked")
    single = keyed.join(marked, mine, "left_anti")
    copies = keyed.join(marked.where("__near_stays"), mine, "left_semi").dropDuplicates([_KEY])
    return single.unionByName(copies).select(*docs.columns)


_KEY = "__near_key"


def _by_text(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that no two texts share: the id, or a number beyond all ids for
    every further text of an id."""
    own = F.col("doc_id").cast("long")
    marks = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    hashed = docs.select(own.alias("__near_id"), *(m.alias(f"__near_h{k}") for k, m in enumerate(marks)))
    spread = hashed.where("__near_id is not null").groupBy("__near_id").agg(
        *(f(f"__near_h{k}").alias(f"__near_{n}{k}") for k in (0, 1) for n, f in (("low", F.min), ("high", F.max)))
    )
    several = spread.where("__near_low0 <> __near_high0 or __near_low1 <> __near_high1").select("__near_id", "__near_low0")
    several = written(several, "several")
    if several.isEmpty():
        return docs.withColumn(_KEY, own)
    few, _ = broadcast_if_small(several)
    texts = docs.join(few, own == F.col("__near_id")).select("__near_id", "text", "__near_low0").distinct()
    # The first text keeps the id; where hashes agree, by its bytes.
    first = texts.where(F.xxhash64("text") == F.col("__near_low0")).groupBy("__near_id").agg(
        F.min("text").alias("__near_first")
    )
    further = texts.join(first.withColumnRenamed("__near_id", "__near_of"), F.col("__near_id") == F.col("__near_of"))
    further = further.where(~F.col("text").eqNullSafe(F.col("__near_first")))
    top = docs.agg(F.max(own)).first()[0]
    number = F.lit(top + 1) + F.monotonically_increasing_id()
    further = written(further.select("__near_id", F.col("text").alias("__near_text"), number.alias("__near_number")), "further")
    same = (own == F.col("__near_id")) & F.col("text").eqNullSafe(F.col("__near_text"))
    keyed = docs.join(further, same, "left")
    return keyed.select(*docs.columns, F.coalesce("__near_number", own).alias(_KEY))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
  WHERE 100 * common >= 75 * (p.n + q.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON d.doc_id = c.a
"""
