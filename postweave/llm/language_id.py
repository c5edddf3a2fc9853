"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in stretches of 128 bytes, forwards and backwards; every position is
labelled from both states, and a document's probabilities are the mean over all its
positions.  The network is trained in numpy by backpropagation through time on a
bounded sample: at most ``DOCS_PER_LANGUAGE`` documents of each language, about, with
``STRETCHES`` stretches each, evenly spaced over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.common import fold, read_table, slices
from postweave.llm.words import raw

FOLDS = 5
STATE = 8
STRETCH = 128
DOCS_PER_LANGUAGE = 400
STRETCHES = 6
#: Stretches that are labelled side by side.
ABREAST = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Network:
    """``inputs`` (2, 3h, 256) and ``states`` (2, 3h, h) of both directions, gates in the order
    update, reset, candidate; ``outputs`` (labels, 2h) and ``bias``."""

    labels: list[str]
    inputs: np.ndarray
    states: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.outputs, self.bias]


def new_network(labels: list[str], h: int = STATE, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        labels,
        draw(2, 3 * h, 256, scale=0.3),
        draw(2, 3 * h, h, scale=0.3),
        draw(len(labels), 2 * h, scale=0.3),
        np.zeros(len(labels), np.float32),
    )


def _forward(inputs: np.ndarray, state: np.ndarray, data: np.ndarray, keep: bool):
    """States of one direction for ``data`` (steps, n), and what the way back needs."""
    h = state.shape[1]
    # A sigmoid is a tanh of half its argument: one call serves both gates.
    half = np.ones((3 * h, 1), np.float32)
    half[: 2 * h] = 0.5
    table, recurrent = inputs * half, state * half
    s = np.zeros((h, data.shape[1]), np.float32)
    states, kept = np.empty((len(data), h, data.shape[1]), np.float32), []
    for t, step in enumerate(data):
        a = np.take(table, step, axis=1)
        u = recurrent @ s
        gates = np.tanh(a[: 2 * h] + u[: 2 * h])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:h], gates[h:]
        n = u[2 * h :] * r
        n += a[2 * h :]
        np.tanh(n, out=n)
        if keep:
            kept.append((s, z, r, n, u[2 * h :]))
        s = (s - n) * z
        s += n
        states[t] = s
    return states, kept


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the second axis of (steps, labels, n)."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def position_probabilities(net: Network, data: np.ndarray) -> np.ndarray:
    """(steps, labels, n) for ``data`` (steps, n)."""
    h = net.states.shape[2]
    ahead, _ = _forward(net.inputs[0], net.states[0], data, False)
    back, _ = _forward(net.inputs[1], net.states[1], data[::-1], False)
    logits = net.outputs[:, :h] @ ahead + net.outputs[:, h:] @ back[::-1]
    logits += net.bias[:, None]
    return _softmax(logits)


def _backward(state: np.ndarray, data: np.ndarray, kept, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of inputs and states of one direction; ``wanted`` is that of each state."""
    h = state.shape[1]
    grad_state = np.zeros_like(state)
    grad_a = np.empty((len(data), 3 * h, data.shape[1]), np.float32)
    carried = np.zeros_like(wanted[0])
    for t in range(len(data) - 1, -1, -1):
        s, z, r, n, un = kept[t]
        g = wanted[t] + carried
        dn = g * (1 - z) * (1 - n * n)
        dz = g * (s - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r])
        grad_a[t] = np.concatenate([dz, dr, dn])
        grad_state += du @ s.T
        carried = g * z + state.T @ du
    flat = data.ravel()
    rows = [np.bincount(flat, grad_a[:, f].ravel(), 256) for f in range(3 * h)]
    return np.array(rows, np.float32), grad_state


def gradients(net: Network, data: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the ``real`` positions of ``data`` (steps, n), and its gradients."""
    h = net.states.shape[2]
    ahead, kept_a = _forward(net.inputs[0], net.states[0], data, True)
    back, kept_b = _forward(net.inputs[1], net.states[1], data[::-1], True)
    back = back[::-1]
    p = _softmax(net.outputs[:, :h] @ ahead + net.outputs[:, h:] @ back + net.bias[:, None])
    n, many = np.arange(data.shape[1]), real.sum()
    loss = -(np.log(p[:, target, n] + 1e-9) * real).sum() / many
    p[:, target, n] -= 1
    p *= (real / many)[:, None, :]
    both = np.concatenate([ahead, back], axis=1)
    grad_out = np.einsum("tln,tkn->lk", p, both, optimize=True)
    wanted = net.outputs.T @ p
    in_a, st_a = _backward(net.states[0], data, kept_a, wanted[:, :h])
    in_b, st_b = _backward(net.states[1], data[::-1], kept_b, wanted[::-1, h:])
    return float(loss), [np.stack([in_a, in_b]), np.stack([st_a, st_b]), grad_out, p.sum((0, 2))]


def train(
    labels: list[str], stretches: list[bytes], target: np.ndarray, steps: int = 240, batch: int = 256, rate: float = 0.02
) -> Network:
    """Fit a network by Adam, in as many steps whatever the number of stretches."""
    net, rng = new_network(labels), np.random.default_rng(11)
    data, real = laid_out(stretches)
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(stretches)):
            order.extend(rng.permutation(len(stretches)).tolist())
        some, order = np.array(order[:batch]), order[batch:]
        _, grads = gradients(net, data[:, some], real[:, some], target[some])
        pace = rate / (1 + 4 * step / steps) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        for w, g, m, v in zip(net.weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * m / (np.sqrt(v) + 1e-6)
    return net


def laid_out(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (steps, n), padded with 0, and which positions are real."""
    data = np.zeros((len(stretches), STRETCH), np.uint8)
    real = np.zeros((len(stretches), STRETCH), np.float32)
    for i, s in enumerate(stretches):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
        real[i, : len(s)] = 1
    return np.ascontiguousarray(data.T), np.ascontiguousarray(real.T)


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, labels): mean over all positions of each text; zeros for an empty one."""
    sizes = np.diff(offsets)
    many = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), many)
    begin = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
    length = np.minimum(STRETCH, offsets[1:][owner] - begin)
    total = np.zeros((len(sizes), len(net.labels)))
    steps = np.arange(STRETCH)[:, None]
    for at in range(0, len(owner), ABREAST):
        b, n = begin[at : at + ABREAST], length[at : at + ABREAST]
        real = steps < n
        block = np.where(real, data[np.minimum(b + steps, len(data) - 1)], 0).astype(np.uint8)
        p = position_probabilities(net, block)
        sums = np.einsum("tln,tn->nl", p, real.astype(np.float32), optimize=False)
        np.add.at(total, owner[at : at + ABREAST], sums)
    return total / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """``(lang, stretch)`` of a bounded share of the labelled rows outside the held-out fold."""
    known = docs.where("lang is not null and length(text) > 0").where(fold(F.col("doc_id"), FOLDS) != 0)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / (1 << 20)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                for k in range(STRETCHES):
                    at = max(0, len(data) - STRETCH) * k // (STRETCHES - 1)
                    if k == 0 or len(data) > STRETCH:
                        langs.append(lang)
                        out.append(data[at : at + STRETCH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "stretch"]
            )

    chosen = known.where(place < share).select("lang", "text")
    return sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(stretches, "lang string, stretch binary").collect())


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Network | None:
    found = sample(docs, docs_per_language)
    labels = sorted({lang for lang, _ in found})
    if not labels:
        return None
    target = np.array([labels.index(lang) for lang, _ in found])
    return train(labels, [s for _, s in found], target)


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` and 0 where the text is null or has
    no letter, or where nothing was learned."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs, scores = _predicted(net, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def _predicted(net: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = raw(texts)
    n = len(offsets) - 1
    if net is None:
        return ["und"] * n, np.zeros(n)
    total = document_probabilities(net, data, offsets)
    best = total.argmax(axis=1)
    scores = total[np.arange(n), best]
    lettered = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]) > 0
    for i in np.flatnonzero(~lettered):
        lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    langs = [net.labels[b] if ok else "und" for b, ok in zip(best, lettered)]
    return langs, np.where(lettered, np.clip(scores, 0, 1), 0.0)


def identified(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Texts that are null or without a letter are ``und`` with score 0; repeated rows are
    labelled each; ``lang`` is read for training alone; an empty table gives no rows.
    """
    out = predicted(docs, fit(docs, docs_per_language))
    held_out = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read_table(spark, sf_dir, "documents"))
