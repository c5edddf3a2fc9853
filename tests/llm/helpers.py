"""Small tables with the awkward cases, and plain restatements to hold operators against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, key STRING, row LONG, n STRING, rank STRING"


def words_of(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def made_up(n: int, seed: int = 1) -> list[str | None]:
    """Texts over a small vocabulary: copies, edits, shared passages, blanks, one long text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Der", "É", "ein,", "x", "$$", "THE!!"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts: list[str | None] = [None, "", " \t\n", "one", "one two", "ONE two", "a b c d", " ", "x" * 5000]
    texts += ["same same same same " * 30, "run " * 40, "run " * 14 + "stop"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2:
            texts.append(rng.choice(texts))
        elif kind < 0.45 and texts[-1]:
            some = words_of(rng.choice([t for t in texts if t and len(t) > 20]))
            at = rng.randrange(len(some))
            texts.append(" ".join(some[:at] + [rng.choice(vocabulary)] + some[at + rng.randrange(2) :]))
        else:
            some = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
            if kind > 0.8:
                at = rng.randrange(len(some))
                some[at:at] = passage[rng.randrange(8) :]
            texts.append(rng.choice([" ", "\n", "  "]).join(some))
    texts[-1] = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    return texts


def table(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    ids = ids or range(len(texts))
    rows = [
        (i, t, ["en", "de", None][k % 3], ["a", "b", "c", None][k % 4], len(t or ""), "k", k, "n", "r")
        for k, (i, t) in enumerate(zip(ids, texts))
    ]
    return spark.createDataFrame(rows, COLUMNS)


def by_id(df, column: str):
    return {r["doc_id"]: r[column] for r in df.collect()}
