"""Language identification with a byte convolutional network.

UTF-8 bytes are embedded; filters of widths 2, 3 and 4 slide over fixed-length windows,
their largest responses in a window go through a softmax layer. The network is trained in
numpy (Adam) on windows of labelled documents. A document's probabilities are those of all
its windows, weighed by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import supervised as sup
from weftline.llm.common import tidy

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
WIDEST = max(WIDTHS)
#: Labelled documents of each language that a fit reads, in all their windows.
PER_CLASS = 500
EPOCHS, BATCH, RATE = 3, 64, 0.004
#: Windows in one matrix product; bounds memory.
AT_ONCE = 256
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(raw: bytes) -> np.ndarray:
    """All bytes in rows of ``WINDOW``, the last one padded with zeros."""
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 is padding
    conv: np.ndarray  # WIDEST * EMBED x filters
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, largest responses and where they are, of some windows of bytes."""
        n = len(w)
        padded = np.zeros((n, WINDOW + WIDEST - 1), np.uint8)
        padded[:, :WINDOW] = w
        e = self.embed[padded].reshape(n, -1)
        s = e.strides
        cols = np.lib.stride_tricks.as_strided(e, (n, WINDOW, WIDEST * EMBED), (s[0], EMBED * s[1], s[1]))
        cols = np.ascontiguousarray(cols).reshape(n * WINDOW, -1)
        z = (cols @ self.conv).reshape(n, WINDOW, -1)
        return cols, z, padded

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(w), AT_ONCE):
            _, z, _ = self.pooled(w[i : i + AT_ONCE])
            h = np.maximum(z.max(axis=1) + self.conv_bias, 0)
            o = h @ self.out + self.out_bias
            o = np.exp(o - o.max(axis=1, keepdims=True))
            out.append(o / o.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability for each text; texts share matrix products."""
        got: list = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return got
        held, owner, size = [], [], 0
        total = np.zeros((len(texts), len(self.langs)))
        asked = []

        def flush() -> None:
            nonlocal held, owner, size
            if held:
                w = np.concatenate(held)
                p = self.probabilities(w) * (w != 0).sum(axis=1, keepdims=True)
                np.add.at(total, np.concatenate(owner), p)
            held, owner, size = [], [], 0

        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                continue
            asked.append(i)
            w = windows(t.encode("utf-8", "surrogatepass"))
            for a in range(0, len(w), 4 * AT_ONCE):
                part = w[a : a + 4 * AT_ONCE]
                held.append(part)
                owner.append(np.full(len(part), i))
                size += len(part)
                if size >= 4 * AT_ONCE:
                    flush()
        flush()
        for i in asked:
            k = int(total[i].argmax())
            got[i] = (self.langs[k], float(total[i, k] / total[i].sum()))
        return got


def _mask() -> np.ndarray:
    """Which weights of the joint filter matrix exist: narrow filters end early."""
    m = np.zeros((WIDEST, EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        m[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return m.reshape(WIDEST * EMBED, -1)


def fit(texts: list[str], langs: list[str], seed: int = 3) -> Network:
    """Train on all windows of texts and their languages; each text's first one also cut short."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    mask = _mask()
    f = mask.shape[1]
    net = Network(names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.2, (f, max(1, len(names)))).astype(np.float32), np.zeros(max(1, len(names)), np.float32))
    net.embed[0] = 0
    rows, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if not raw:
            continue
        own = [windows(raw), windows(raw[: int(rng.integers(24, WINDOW + 1))])]
        rows += own
        ys += [names.index(lang)] * sum(map(len, own))
    if not rows or len(names) < 2:
        return net
    x, y = np.concatenate(rows), np.array(ys)
    params = [net.embed, net.conv, net.conv_bias, net.out, net.out_bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            n = len(own)
            cols, z, padded = net.pooled(x[own])
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + net.conv_bias
            h = np.maximum(top, 0)
            o = h @ net.out + net.out_bias
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[own]] -= 1
            p /= n
            g_out, g_ob = h.T @ p, p.sum(axis=0)
            gh = (p @ net.out.T) * (top > 0)
            rows_at = (np.arange(n)[:, None] * WINDOW + at).ravel()
            picked = cols[rows_at].reshape(n, f, -1)
            g_conv = np.einsum("nf,nfc->cf", gh, picked, optimize=True) * mask
            back = (gh[:, :, None] * net.conv.T[None]).reshape(n * f, WIDEST, EMBED)
            g_embed = np.zeros_like(net.embed)
            seen = padded[np.repeat(np.arange(n), f)[:, None], at.ravel()[:, None] + np.arange(WIDEST)]
            np.add.at(g_embed, seen.ravel(), back.reshape(-1, EMBED))
            g_embed[0] = 0
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for q, g, a, b in zip(params, [g_embed, g_conv, gh.sum(axis=0), g_out, g_ob], m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _predict(net_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_var.value
        for b in batches:
            got = [r for i in range(0, b.num_rows, 256) for r in net.predict(b.column(1).slice(i, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def fit_network(docs: DataFrame, parts: int = 4, part: int = 2, per_class: int = PER_CLASS) -> Network:
    """Fit on about ``per_class`` documents of each language, held-out rows left out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~sup.held_out(F.col("doc_id"), parts, part))
    chosen, _ = sup.thin(known, "lang", per_class)
    got = sup.one_text_each(chosen.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")).collect()
    sample = sorted((r.doc_id, r.text, r.lang) for r in got)
    return fit([s[1] for s in sample], [s[2] for s in sample])


def identify(docs: DataFrame, parts: int = 4, part: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its probability) for each row.

    ``und`` with score 0 where the text is null or has no letter, or where no language could
    be learnt. Whole texts are read. Repeated rows are predicted each; a null doc_id isn't
    held out and is never learnt from; other columns aren't read.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit_network(docs, parts, part, per_class))
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_predict(net)), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", sup.held_out(F.col("doc_id"), parts, part).alias("held_out"), "lang_pred", "score")
