"""Operator 7: language identification with a bidirectional gated recurrent network over bytes, in numpy.

Network: two GRUs read the UTF-8 bytes of a text forwards and backwards, both states of a position give one score per
language, and a softmax labels every position. A document's probabilities are the means over all its positions. Texts
are cut into windows of WINDOW bytes, whose first and last MARGIN bytes are read by two windows and labelled once; so
all windows of many texts go through the network side by side and a text of any length is read whole. The gates are
piecewise linear (hard sigmoid and hard tanh), which keeps a position cheap.

Training: backpropagation through time with Adam on windows of at most `per_language` training documents of each
language and about `most_documents` in all (rows with the smallest hash of doc_id; a null doc_id is not drawn;
`windows_per_document` windows spread over the whole text of each). That sample is the only thing that reaches the driver,
and its size is bounded by these parameters; more languages than `most_documents` are an error.

Defined cases: null texts and texts without a letter are `und` with score 0; a document's score is the mean
probability of its language; ties go to the language that is first by code point; without any training document all
are `und` with score 0; repeated rows are each labelled; columns that clash are replaced, all others are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import stored
from siltstone.sources.tables import table

HIDDEN = 8
#: Bytes of a window, and those at either end that its neighbours label.
WINDOW, MARGIN = 192, 8
#: Windows that go through the network together.
TOGETHER = 2048
LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a text has a character of one of Unicode's letter categories; signs for numbers are none."""
    return bool(LATIN.search(text)) or any(map(str.isalpha, text))


def init(languages: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random parameters. Gates are in the order reset, update, candidate; `x` holds the input's share per byte."""
    p = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
        p["u" + d] = rng.normal(0, 0.4, (3 * hidden, hidden))
        p["c" + d] = np.zeros((3 * hidden, 1))
    p["o"], p["q"] = rng.normal(0, 0.2, (languages, 2 * hidden)), np.zeros((languages, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}



def run_gru(p: dict[str, np.ndarray], d: str, windows: np.ndarray, keep: bool):
    """States (time, hidden, windows) for byte windows (time, windows), and what the backward pass needs."""
    steps, n = windows.shape
    hidden = p["u" + d].shape[1]
    x, u, c = np.ascontiguousarray(p["x" + d].T), p["u" + d], p["c" + d]
    h, states, trace = np.zeros((hidden, n), np.float32), np.empty((steps, hidden, n), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a, b = np.take(x, windows[t], axis=1), u @ h
        b += c
        gates = a[: 2 * hidden]
        gates += b[: 2 * hidden]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        r, z, s = gates[:hidden], gates[hidden:], b[2 * hidden :]
        m = r * s
        m += a[2 * hidden :]
        np.clip(m, -1, 1, out=m)
        if keep:
            trace.append((t, h, r.copy(), z.copy(), s.copy(), m.copy()))
        new = h - m
        new *= z
        new += m
        states[t] = h = new
    return states, trace


def back_gru(p: dict[str, np.ndarray], d: str, windows: np.ndarray, trace: list, grad: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Adds the gradients of one direction to g; grad: of the loss by the states."""
    u, hidden = p["u" + d], p["u" + d].shape[1]
    carried, shares = np.zeros_like(grad[0]), np.empty((len(grad), 3 * hidden, windows.shape[1]), np.float32)
    for t, h, r, z, s, m in reversed(trace):
        dh = grad[t] + carried
        dm = dh * (1 - z) * ((m > -1) & (m < 1))
        dz = dh * (h - m) * 0.25 * ((z > 0) & (z < 1))
        dr = dm * s * 0.25 * ((r > 0) & (r < 1))
        inner = np.concatenate((dr, dz, dm * r))
        g["u" + d] += inner @ h.T
        g["c" + d] += inner.sum(axis=1, keepdims=True)
        shares[t] = np.concatenate((dr, dz, dm))
        carried = dh * z + u.T @ inner
    at = windows.ravel()
    for i in range(3 * hidden):
        g["x" + d][:, i] += np.bincount(at, shares[:, i].ravel(), 256)


def softmax(scores: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return scores


def step(p: dict[str, np.ndarray], windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of (time, windows), and its gradients."""
    steps, n = windows.shape
    forward, trace_f = run_gru(p, "f", windows, True)
    backward, trace_b = run_gru(p, "b", windows, True)
    both = np.concatenate((forward, backward), axis=1)
    scores = np.einsum("lh,thn->ltn", p["o"], both) + p["q"][:, :, None]
    probs = softmax(scores)
    loss = -np.log(np.maximum(probs[labels[None, :], np.arange(steps)[:, None], np.arange(n)[None, :]], 1e-9)).mean()
    ds = probs
    ds[labels[None, :], np.arange(steps)[:, None], np.arange(n)[None, :]] -= 1
    ds /= steps * n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"], g["q"] = np.einsum("ltn,thn->lh", ds, both), ds.sum(axis=(1, 2))[:, None]
    dboth = np.einsum("lh,ltn->thn", p["o"], ds)
    hidden = forward.shape[1]
    back_gru(p, "f", windows, trace_f, dboth[:, :hidden], g)
    back_gru(p, "b", windows, trace_b, dboth[:, hidden:], g)
    return float(loss), g


def train(windows: np.ndarray, labels: np.ndarray, languages: int, hidden: int = HIDDEN, steps: int = 260, batch: int = 96, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted by Adam; windows: (number, bytes). The same input gives the same parameters."""
    rng = np.random.default_rng(seed)
    p = init(languages, hidden, rng)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    by_label = [np.flatnonzero(labels == i) for i in range(languages)]
    for i in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(x, batch // languages + 1) for x in by_label])
        _, g = step(p, np.ascontiguousarray(windows[chosen].T), labels[chosen])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.03 * min(1.0, 1.5 * (1 - i / (steps + 1))) * min(1.0, i / 10)
        for k in p:
            v = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
    return p


def label_positions(p: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Probabilities (languages, time, windows) of every position of (time, windows)."""
    forward, _ = run_gru(p, "f", windows, False)
    backward, _ = run_gru(p, "b", windows, False)
    hidden = forward.shape[1]
    scores = np.matmul(p["o"][:, :hidden], forward) + np.matmul(p["o"][:, hidden:], backward) + p["q"]
    return softmax(scores.transpose(1, 0, 2))


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (number, WINDOW) of zero-padded data, and the range [from, to) of each that it labels."""
    inner = WINDOW - 2 * MARGIN
    n = max(1, -(-(len(data) - 2 * MARGIN) // inner))
    padded = np.zeros((n - 1) * inner + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(n) * inner
    lo, hi = np.full(n, MARGIN), np.full(n, WINDOW - MARGIN)
    lo[0], hi[-1] = 0, len(data) - at[-1]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at], lo, hi


class Pool:
    """Collects the windows of many texts and adds up the position probabilities of each text."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.queue, self.size = p, [], 0
        self.sums: dict[int, np.ndarray] = {}
        self.counts: dict[int, int] = {}

    def add(self, number: int, data: bytes) -> None:
        windows, lo, hi = cut(data)
        for i in range(0, len(windows), TOGETHER):
            part = windows[i : i + TOGETHER]
            self.queue.append((np.full(len(part), number), part, lo[i : i + TOGETHER], hi[i : i + TOGETHER]))
            self.size += len(part)
            if self.size >= TOGETHER:
                self.flush()

    def flush(self) -> None:
        if not self.queue:
            return
        number, windows, lo, hi = (np.concatenate(x) for x in zip(*self.queue))
        self.queue, self.size = [], 0
        for i in range(0, len(number), TOGETHER):
            who, part = number[i : i + TOGETHER], np.ascontiguousarray(windows[i : i + TOGETHER].T)
            probs = label_positions(self.p, part)
            at = np.arange(WINDOW)[:, None]
            probs *= (at >= lo[None, i : i + TOGETHER]) & (at < hi[None, i : i + TOGETHER])
            total, counts = probs.sum(axis=1, dtype=np.float64), hi[i : i + TOGETHER] - lo[i : i + TOGETHER]
            for j in np.flatnonzero(np.diff(who, prepend=-1)).tolist():
                end = int(np.searchsorted(who, who[j], side="right")) if j + 1 < len(who) and who[j + 1] == who[j] else j + 1
                k = int(who[j])
                self.sums[k] = self.sums.get(k, 0) + total[:, j:end].sum(axis=1)
                self.counts[k] = self.counts.get(k, 0) + int(counts[j:end].sum())

    def take(self) -> dict[int, np.ndarray]:
        """Mean probabilities by number; the pool is empty afterwards."""
        self.flush()
        out = {k: v / self.counts[k] for k, v in self.sums.items()}
        self.sums, self.counts = {}, {}
        return out


def training_windows(labelled: DataFrame, per_language: int, windows_per_document: int, most_documents: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and languages of a bounded sample of (doc_id, text, lang)."""
    hashed = F.xxhash64("doc_id", F.lit("langid"))
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    usable = labelled.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND octet_length(text) > 0")
    # of each language about 4 * per_language ids, those with the smallest hashes, are ranked, without their texts
    ids = usable.select("doc_id", "lang")
    share = stored(ids.groupBy("lang").agg((4.0 * per_language / F.count(F.lit(1))).alias("share")), "langid-shares")
    if (number := share.count()) > most_documents:
        raise ValueError(f"{number} languages are more than the {most_documents} documents of a sample")
    per_language = min(per_language, most_documents // max(1, number))
    small = ids.join(F.broadcast(share), "lang").filter((hashed.cast("double") + 2.0**63) / 2.0**64 < F.col("share"))
    chosen = stored(small.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("doc_id").distinct(), "langid-sample")
    each = Window.partitionBy("doc_id").orderBy("lang", "text")
    some = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").withColumn("r", F.row_number().over(each)).filter("r = 1")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                data = text.as_py().encode("utf-8", "replace")
                for i in range(min(windows_per_document, 1 + len(data) // WINDOW)):
                    at = (len(data) - WINDOW) * i // max(1, windows_per_document - 1) if len(data) > WINDOW else 0
                    langs.append(lang.as_py())
                    parts.append(data[at : at + WINDOW].ljust(WINDOW, b" "))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "part": pa.array(parts, pa.binary())})

    rows = sorted((r.lang, bytes(r.part)) for r in some.select("lang", "text").mapInArrow(spread, "lang string, part binary").collect())
    languages = sorted({lang for lang, _ in rows}, key=lambda x: x.encode())
    windows = np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([languages.index(lang) for lang, _ in rows], np.int64), languages


def fit(labelled: DataFrame, per_language: int = 300, windows_per_document: int = 4, most_documents: int = 60_000) -> tuple[dict[str, np.ndarray] | None, list[str]]:
    """The network and its languages, from (doc_id, text, lang); None if there is nothing to learn from."""
    windows, labels, languages = training_windows(labelled, per_language, windows_per_document, most_documents)
    return (train(windows, labels, len(languages)), languages) if languages else (None, [])


def predict(docs: DataFrame, model: dict[str, np.ndarray] | None, languages: list[str], text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the predicted language and its score; no column but the text is looked at."""
    rest = docs.drop(*[c for c in (lang, score) if c != text])
    schema = rest.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(model) if model else None
        for batch in batches:
            texts = batch.column(text)
            if pool:
                for i in range(batch.num_rows):
                    x = texts[i].as_py()
                    if x and has_letter(x):
                        pool.add(i, x.encode("utf-8", "replace"))
            means = pool.take() if pool else {}
            best = [int(means[i].argmax()) if i in means else -1 for i in range(batch.num_rows)]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[lang] = pa.array([languages[b] if b >= 0 else "und" for b in best], pa.string())
            columns[score] = pa.array([min(1.0, float(means[i][b])) if b >= 0 else 0.0 for i, b in enumerate(best)], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return rest.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of the documents, by crc32 of the doc_id, is held out of training."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model, languages = fit(docs.filter("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model, languages).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
