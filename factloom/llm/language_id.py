"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of STEPS bytes. A gated recurrent layer reads every
window forwards and another backwards, with hard sigmoid gates and a hard tanh
candidate; a linear layer on both states labels every position, and a
document's probabilities are the mean over all its positions. The network is
trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Width of a direction's state, bytes of a window, windows that go through the network together.
WIDTH, STEPS, TOGETHER = 8, 96, 2048
#: Bounds of training: documents of each language, windows of a document, rounds, windows of a round (4 of each language at least).
TRAIN_DOCS, TRAIN_WINDOWS, ROUNDS, ROUND_WINDOWS = 150, 12, 400, 192
UNKNOWN = "und"
SEED = 7
#: Symbol past the end of a text.
PAD = 256


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4))


@dataclass
class Network:
    """Parameters. First axis of x, u, b: direction. x: 257 symbols to the inputs of update, reset and candidate."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], rng) -> Network:
        x = rng.normal(0, 0.4, (2, PAD + 1, 3 * WIDTH)).astype(np.float32)
        u = (rng.normal(0, 1, (2, WIDTH, 3 * WIDTH)) / np.sqrt(WIDTH)).astype(np.float32)
        return cls(langs, x, u, rng.normal(0, 0.3, (2 * WIDTH, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))

    def states(self, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, both directions) for symbols (windows, steps). keep: gets what the backward pass needs."""
        n, steps = symbols.shape
        both = np.stack([symbols.T, symbols.T[::-1]], 1)  # steps, direction, windows
        h = np.zeros((2, n, WIDTH), np.float32)
        out = np.empty((steps, n, 2 * WIDTH), np.float32)
        table = self.x.reshape(-1, 3 * WIDTH)
        shift = np.array([[0], [PAD + 1]])
        for t in range(steps):
            g = table[both[t] + shift]
            m = np.matmul(h, self.u)
            gates = g[..., : 2 * WIDTH] + m[..., : 2 * WIDTH]
            gates *= 0.2
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            cand = m[..., 2 * WIDTH :] * gates[..., WIDTH:]
            cand += g[..., 2 * WIDTH :]
            np.clip(cand, -1, 1, out=cand)
            new = h - cand
            new *= gates[..., :WIDTH]
            new += cand
            if keep is not None:
                keep.append((both[t], h, m[..., 2 * WIDTH :].copy(), gates, cand))
            h = new
            out[t, :, :WIDTH] = h[0]
            out[steps - 1 - t, :, WIDTH:] = h[1]
        return out

    def positions(self, symbols: np.ndarray, keep: list | None = None):
        """(states, probabilities of each language at each position): steps, windows, languages."""
        s = self.states(symbols, keep)
        z = s.reshape(-1, 2 * WIDTH) @ self.out
        z += self.bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return s, z.reshape(*s.shape[:2], -1)

    def gradients(self, symbols: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over the positions that aren't padding, back through time."""
        kept: list = []
        s, p = self.positions(symbols, kept)
        steps, n = s.shape[:2]
        weight = (symbols.T != PAD).astype(np.float32)
        d = p
        d[:, np.arange(n), labels] -= 1
        d *= (weight / max(1.0, weight.sum()))[..., None]
        flat = d.reshape(-1, d.shape[-1])
        d_out, d_bias = s.reshape(-1, 2 * WIDTH).T @ flat, flat.sum(0)
        ds = (flat @ self.out.T).reshape(steps, n, 2 * WIDTH)
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros((2, n, WIDTH), np.float32)
        for t in range(steps - 1, -1, -1):
            symbol, h, m, gates, cand = kept[t]
            dh[0] += ds[t, :, :WIDTH]
            dh[1] += ds[steps - 1 - t, :, WIDTH:]
            update, reset = gates[..., :WIDTH], gates[..., WIDTH:]
            dc = dh * (1 - update) * (np.abs(cand) < 1)
            dg = np.concatenate([dh * (h - cand), dc * m], -1) * 0.2 * ((gates > 0) & (gates < 1))
            dm = np.concatenate([dg, dc * reset], -1)
            du += np.matmul(h.transpose(0, 2, 1), dm)
            into = np.concatenate([dg, dc], -1)
            for k in range(2):
                np.add.at(dx[k], symbol[k], into[k])
            dh = dh * update + np.matmul(dm, self.u.transpose(0, 2, 1))
        return [dx, du, d_out, d_bias]


def window_places(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, document) of the windows of texts."""
    each = -(-np.diff(cuts) // STEPS)
    owner = np.repeat(np.arange(len(each)), each)
    first = np.concatenate([[0], np.cumsum(each)])
    return cuts[:-1][owner] + (np.arange(len(owner)) - first[owner]) * STEPS, owner


def windows_at(data: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows of STEPS symbols from start; past their text's end they are padded."""
    if not len(start):
        return np.zeros((0, STEPS), np.int16)
    at = start[:, None] + np.arange(STEPS)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(PAD))


def document_probabilities(net: Network, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions of each text; rows of no bytes are zero. TOGETHER windows are in memory at once."""
    total = np.zeros((len(cuts) - 1, len(net.langs)))
    start, owner = window_places(cuts)
    for a in range(0, len(start), TOGETHER):
        mine = owner[a : a + TOGETHER]
        part = windows_at(data, cuts[1:][mine], start[a : a + TOGETHER])
        _, p = net.positions(part)
        if (part == PAD).any():
            p *= (part.T != PAD)[..., None]
        np.add.at(total, mine, p.sum(0))
    return total / np.maximum(1, np.diff(cuts))[:, None]


def train(texts: list[bytes], labels: list[str], seed: int = SEED) -> Network:
    """Adam over random windows, the same number of each language in a round."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    net = Network.new(langs, rng)
    pools = []
    for lang in langs:
        mine = []
        for text in (t for t, x in zip(texts, labels, strict=True) if x == lang):
            data = np.frombuffer(text, np.uint8)
            start, _ = window_places(np.array([0, len(data)]))
            w = windows_at(data, np.full(len(start), len(data)), start)
            mine.append(w[np.sort(rng.permutation(len(w))[:TRAIN_WINDOWS])])
        pools.append(np.concatenate(mine))
    params = [net.x, net.u, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each = max(4, ROUND_WINDOWS // len(langs))
    for k in range(1, ROUNDS + 1):
        batch = np.concatenate([p[rng.integers(0, len(p), each)] for p in pools])
        grads = net.gradients(batch, np.repeat(np.arange(len(langs)), each))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
        rate = 0.02 * min(1.0, k / 20) * (1.05 - k / ROUNDS)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from labelled rows that aren't held out; None if there are none.

    All languages are learned. At most TRAIN_DOCS documents of each are read by
    the driver: those of smallest hash of the id.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (split_of(F.col(id_col)) != 2))
    marked = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col)).alias("_h"))
    # one pass for all languages: each task keeps TRAIN_DOCS rows of a language before the shuffle
    first = Window.partitionBy("_lang").orderBy("_h", "_id")
    ids = [r[0] for r in marked.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= TRAIN_DOCS).select("_id").distinct().collect()]
    if not ids:
        return None
    rows = known.filter(F.col(id_col).isin(ids)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    # repeated ids would break the bound
    one = Window.partitionBy("_id").orderBy("_lang", "_text")
    sample = rows.filter(F.length("_text") > 0).withColumn("_k", F.row_number().over(one)).filter("_k = 1").orderBy("_id").collect()
    return train([r["_text"].encode() for r in sample], [r["_lang"] for r in sample]) if sample else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, columns of keep, lang_pred, score (its mean probability over all positions of the whole text).

    lang_pred is UNKNOWN, with score 0, for a text that is null or has no
    letter, and for all if there is no network. Ties go to the first language
    by name. Every row gives a row, repeated rows and rows without id too; an empty table gives an empty
    table; columns not in keep are not read. A kept column named lang_pred or score gives way to the result.
    """
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some kB, whatever the input
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    source = docs.select(id_col, text_col, *keep)

    def run(batches):
        import pyarrow as pa

        net = shared.value
        for b in batches:
            column = b.column(1)
            names, scores = [], []
            texts = column.to_pylist()
            bad = [net is None or t is None or not any(map(str.isalpha, t)) for t in texts]
            for a in range(0, len(texts), 256):
                if net is None:
                    p = None
                else:
                    p = document_probabilities(net, *common.text_bytes(column.slice(a, 256)))
                for k, no in enumerate(bad[a : a + 256]):
                    best = 0 if no else int(p[k].argmax())
                    names.append(UNKNOWN if no else net.langs[best])
                    scores.append(0.0 if no else min(1.0, float(p[k, best])))
            kept = [b.column(2 + k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([b.column(0), *kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, *keep, "lang_pred", "score"])
        common.release()

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["lang_pred string", "score double"]))
