"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample. It labels every byte position of a text, and the document's
probabilities are the mean over its positions. Long texts are cut into chunks
that are read side by side; each chunk starts and ends with its neighbours'
bytes as context, so positions at a cut are labelled as well as others.

Gates are piecewise linear (clipped), which costs a fraction of exponentials.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import passed_through

#: Most training documents, over all languages, and most bytes that are taken from each.
SAMPLE, SAMPLE_BYTES = 1_600, 512
HIDDEN = 8
CHUNK, CONTEXT = 240, 8
#: Chunks that are read side by side.
LANES = 1_024
UNKNOWN = "und"


def encode(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


@dataclass
class Network:
    """Weights of both directions: input tables (256 x 3H: update, reset, candidate), recurrent (H x 2H, H x H), and the output layer."""

    labels: list[str]
    table: list[np.ndarray]
    gates: list[np.ndarray]
    candidate: list[np.ndarray]
    out: np.ndarray  # (2H + 1) x labels, the last row being the bias

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.gates, *self.candidate, self.out]


def _new(labels: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    table = [draw(256, 3 * hidden, scale=0.5) for _ in "fb"]
    for t in table:
        t[:, :hidden] -= 0.5  # updates start slow, so states last
    return Network(labels, table, [draw(hidden, 2 * hidden, scale=0.4) for _ in "fb"], [draw(hidden, hidden, scale=0.4) for _ in "fb"], draw(2 * hidden + 1, len(labels), scale=0.3))


def _run(net: Network, side: int, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """States (steps x H x lanes) of one direction over ``data`` (steps x lanes); what backpropagation needs if ``keep``.

    Features come before lanes, so every operation is on contiguous rows. The
    slope and middle of the clipped gates are part of the weights used here.
    """
    steps, lanes = data.shape
    hidden = net.candidate[side].shape[0]
    table = np.ascontiguousarray(net.table[side].T)
    table[: 2 * hidden] = table[: 2 * hidden] * 0.25 + 0.5
    u_gates, u_cand = np.ascontiguousarray(net.gates[side].T) * np.asarray(0.25, table.dtype), np.ascontiguousarray(net.candidate[side].T)
    states = np.zeros((steps, hidden, lanes), table.dtype)
    h, x = np.zeros((hidden, lanes), table.dtype), np.zeros((3 * hidden, lanes), table.dtype)
    saved = []
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        np.take(table, data[t], axis=1, out=x, mode="clip")
        g = u_gates @ h
        g += x[: 2 * hidden]
        np.maximum(g, 0, out=g)
        np.minimum(g, 1, out=g)
        rh = g[hidden:] * h
        c = u_cand @ rh
        c += x[2 * hidden :]
        np.maximum(c, -1, out=c)
        np.minimum(c, 1, out=c)
        if keep:
            saved.append((h, g, rh, c))
        move = c - h
        move *= g[:hidden]
        h = np.add(h, move, out=states[t])
    return states, saved


def _probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Softmax (steps x labels x lanes) of each position."""
    hidden = forward.shape[1]
    weights = np.ascontiguousarray(net.out.T)
    p = weights[:, :hidden] @ forward
    p += weights[:, hidden : 2 * hidden] @ backward
    p += weights[:, -1:]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(net: Network, data: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss (weighted mean cross-entropy of all positions) and its gradients by backpropagation through time.

    ``data`` is steps x lanes bytes, ``target`` a label for each lane, and
    ``weight`` steps x lanes (0 for padding).
    """
    hidden = net.candidate[0].shape[0]
    sides = [_run(net, s, data, True) for s in (0, 1)]
    p = _probabilities(net, sides[0][0], sides[1][0])
    steps, lanes = data.shape
    share = weight / max(weight.sum(), 1e-9)
    at = p[:, target, np.arange(lanes)]
    loss = float(-(share * np.log(np.maximum(at, 1e-12))).sum())
    d = p * share[:, None, :]
    d[:, target, np.arange(lanes)] -= share
    g_out = np.concatenate([*(np.einsum("thb,tkb->hk", states, d) for states, _ in sides), d.sum(axis=(0, 2))[None, :]])
    order = np.argsort(data.ravel(), kind="stable")
    values, firsts = np.unique(data.ravel()[order], return_index=True)
    g_table, g_gates, g_cand = [], [], []
    for side in (0, 1):
        d_states = net.out[side * hidden : (side + 1) * hidden] @ d
        gg, gc = np.zeros_like(net.gates[side]), np.zeros_like(net.candidate[side])
        inputs = np.zeros((steps, lanes, 3 * hidden), d.dtype)
        times = range(steps - 1, -1, -1) if side == 0 else range(steps)
        dh = np.zeros((hidden, lanes), d.dtype)
        for t, (h, g, rh, c) in zip(times, reversed(sides[side][1]), strict=True):
            dh = dh + d_states[t]
            z, r = g[:hidden], g[hidden:]
            dc = dh * z * ((c > -1) & (c < 1))
            d_rh = net.candidate[side] @ dc
            gc += rh @ dc.T
            dg = np.concatenate([dh * (c - h), d_rh * h]) * (0.25 * ((g > 0) & (g < 1)))
            gg += h @ dg.T
            inputs[t] = np.concatenate([dg, dc]).T
            dh = dh * (1 - z) + d_rh * r + net.gates[side] @ dg
        gt = np.zeros_like(net.table[side])
        gt[values] = np.add.reduceat(inputs.reshape(-1, 3 * hidden)[order], firsts, axis=0)
        g_table.append(gt)
        g_gates.append(gg)
        g_cand.append(gc)
    return loss, [*g_table, *g_gates, *g_cand, g_out]


def fit(texts: list[bytes], labels: list[str], *, hidden: int = HIDDEN, steps: int = 64, epochs: int = 6, lanes: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Train with Adam on windows of ``steps`` bytes, each language weighing the same. Without texts the network knows no language."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = _new(names or [UNKNOWN], hidden, rng)
    if len(names) < 2:
        return net
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        for at in range(0, max(1, len(text) - steps // 2), steps):
            windows.append(text[at : at + steps])
            target.append(names.index(label))
    size = np.array([len(w) for w in windows])
    data = np.frombuffer(b"".join(w.ljust(steps, b" ") for w in windows), np.uint8).reshape(-1, steps).astype(np.intp)
    target = np.array(target)
    balance = len(windows) / np.maximum(np.bincount(target, size / steps, len(names)), 1e-9) / len(names)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    turn, turns = 0, epochs * max(1, -(-len(windows) // lanes))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), lanes):
            pick = order[at : at + lanes]
            weight = ((np.arange(steps)[:, None] < size[pick]) * balance[target[pick]]).astype(np.float32)
            _, grads = gradients(net, np.ascontiguousarray(data[pick].T), target[pick], weight)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            turn += 1
            pace = rate * (1 - 0.9 * turn / turns)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return net


def pooled(net: Network, texts: list[bytes], *, lanes: int = LANES) -> np.ndarray:
    """Mean over all positions of each text (texts x labels) of the position's probabilities; zeros for an empty text."""
    width = CHUNK + 2 * CONTEXT
    out = np.zeros((len(texts), len(net.labels)))
    pad = bytes(CONTEXT)
    owner, starts, padded, at = [], [], [], 0
    for i, text in enumerate(texts):
        n = -(-len(text) // CHUNK)
        padded.append(pad + text + bytes(n * CHUNK - len(text)) + pad)
        owner.append(np.full(n, i))
        starts.append(at + np.arange(n) * CHUNK)
        at += len(padded[-1])
    if not owner:
        return out
    flat = np.frombuffer(b"".join(padded), np.uint8)
    owner, starts = np.concatenate(owner), np.concatenate(starts)
    sizes = np.array([len(t) for t in texts])
    chunks = -(-sizes // CHUNK)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    held = np.minimum(CHUNK, sizes[owner] - place * CHUNK)
    for part in range(0, len(owner), lanes):
        own = owner[part : part + lanes]
        data = flat[starts[part : part + lanes][None, :] + np.arange(width)[:, None]].astype(np.intp)
        forward, _ = _run(net, 0, data, False)
        backward, _ = _run(net, 1, data, False)
        p = _probabilities(net, forward[CONTEXT : CONTEXT + CHUNK], backward[CONTEXT : CONTEXT + CHUNK])
        p *= (np.arange(CHUNK)[:, None] < held[part : part + lanes])[:, None, :]
        np.add.at(out, own, p.sum(axis=0).T)
    return out / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; such documents are never learned from."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on at most ``sample`` documents with a label that are not held out, as many of each language as there are.

    Those of the smallest hashes of their ids are taken; of a longer document,
    stretches of 64 bytes evenly spaced over the whole text, ``sample_bytes`` in
    all. Of rows that repeat an id, the one of the smallest text is taken.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(True)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return fit([], [])
    each = max(1, sample // len(sizes))
    wanted = F.lit(False)
    for label, n in sizes.items():
        wanted = wanted | ((F.col("label") == label) & (F.shiftrightunsigned(F.xxhash64("id"), 1) <= F.lit(min(int(each / n * 2**63), 2**63 - 1))))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = []
            for text in b["text"]:
                raw, n = encode(text), sample_bytes // 64
                at = [0] if len(raw) <= 64 else [int(k * (len(raw) - 64) / (n - 1)) for k in range(n)] if len(raw) > sample_bytes else range(0, len(raw), 64)
                cut.append(b"".join(raw[a : a + 64] for a in at))
            yield pd.DataFrame({"id": b["id"].to_numpy(), "label": b["label"].to_numpy(), "raw": cut})

    got = sorted(((r["id"], r["label"], bytes(r["raw"])) for r in rows.where(wanted).groupBy("id").agg(F.min(F.struct("text", "label")).alias("r")).select("id", "r.text", "r.label").mapInPandas(stretches, "id long, label string, raw binary").toLocalIterator()))
    return fit([r[2] for r in got], [r[1] for r in got])


def predict(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with held_out (boolean), lang_pred (string) and score (double, 0 to 1).

    ``lang_pred`` is the language of the largest pooled probability, which is
    the score. A null text, or one without a letter, is ``und`` with score 0.
    Only the text is an input. Rows are labelled each for itself; a null id is
    not held out. Input columns named like a result are replaced; an empty
    table gives an empty result.
    """
    others = passed_through(docs, "held_out", "lang_pred", "score", "__li")
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights a language

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        net = held.value
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        at = 0
        while at < len(known):
            end, size = at, 0
            while end < len(known) and (end == at or size < 2_000_000):
                size += len(texts.iloc[known[end]])
                end += 1
            p = pooled(net, [encode(texts.iloc[i]) for i in known[at:end]])
            names[known[at:end]] = np.array(net.labels, object)[p.argmax(axis=1)]
            score[known[at:end]] = np.clip(p.max(axis=1), 0, 1)
            at = end
        return pd.DataFrame({"lang_pred": names, "score": score})

    rows = docs.select(*others, label(F.col(text_col)).alias("__li"))
    return rows.select(*others, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "__li.lang_pred", "__li.score")
