"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from counts of its bytes
and words; gated attention weighs the encodings, and the weighted sum is scored. Only documents have
labels: which passages speak for them is learned. Trained here, in NumPy, on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import SPACED, bounded_batches, crc_mod, hash_words, ids_and_texts, text_slices

PASSAGE = 48  #: words
SAMPLE_DOCS = 6_000  #: labelled documents that the model is fitted on, at most
SAMPLE_PASSAGES = 24  #: passages of each of them, at most, evenly from the whole text; scoring reads all
HIDDEN, GATE = 24, 12
EPOCHS = 300
N_FEATURES = 19

_CLASSES = [
    [range(65, 91)],
    [range(97, 123)],
    [range(48, 58)],
    [b"#*$%&<>"],
    [b"|"],
    [b"!"],
    [b".,;:?"],
    [range(128, 192)],
    [b"\n"],
    [b"\"'()=_-+@/\\[]{}~^`"],
]


def passage_features(texts: pa.Array):
    """For each text an array of passages by features; a text without words has one passage of zeros."""
    tables = np.zeros((len(_CLASSES), 256), dtype=bool)
    for table, parts in zip(tables, _CLASSES, strict=True):
        for part in parts:
            table[list(part)] = True
    for _, data, ends in text_slices(texts):
        words, start, end, upto = hash_words(data, ends, SPACED)
        rows = np.concatenate([[0], upto])
        per_row = -(-np.diff(rows) // PASSAGE)
        first = np.concatenate([np.arange(a, b, PASSAGE) for a, b in zip(rows[:-1], rows[1:], strict=True)]) if len(words) else np.zeros(0, np.int64)
        at = 0
        if len(first):
            row_of = np.repeat(np.arange(len(per_row)), per_row)
            last = np.minimum(first + PASSAGE, rows[row_of + 1])
            n = (last - first).astype(np.float64)
            # bytes from a passage's first word to the next passage's
            reach = np.append(start[first[1:]], len(data))
            counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])[np.append(start[first], len(data))]) for t in tables], axis=1)
            size = np.maximum(reach - start[first], 1)
            length = np.add.reduceat(end - start, first) / n
            same = lambda k: np.add.reduceat(np.concatenate([np.zeros(min(k, len(words)), bool), words[k:] == words[:-k]]).astype(np.int64), first) / n
            passage = np.repeat(np.arange(len(first)), last - first)
            order = np.lexsort((words, passage))
            w, p = words[order], passage[order]
            new = np.append(True, (w[1:] != w[:-1]) | (p[1:] != p[:-1]))
            distinct = np.add.reduceat(new.astype(np.int64), first) / n
            upper_first = np.add.reduceat(((data[start] >= 65) & (data[start] <= 90)).astype(np.int64), first) / n
            made = np.column_stack(
                [counts[:, 0] / size, counts[:, 1] / size, counts[:, 2] / size, counts[:, 3:] / n[:, None], length / 10, distinct, same(1), same(2), same(5), upper_first, np.log1p(n) / 4]
            )
            found = np.column_stack([made, np.repeat(np.log1p(np.diff(rows)) / 8, per_row), np.ones(len(first))]).astype(np.float32)
        for count in per_row:
            if count:
                yield found[at : at + count]
                at += count
            else:
                yield np.zeros((1, N_FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """All that the model computes of bags; ``starts``: the first passage of each."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(((x - m["mean"]) / m["scale"]) @ m["W"] + m["w0"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * s) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    weight = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"bag": bag, "h": h, "t": t, "s": s, "weight": weight, "z": z, "score": _sigmoid(z @ m["c"] + m["c0"])}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """The fitted model, as arrays; full-batch Adam on the log loss. Without both labels it scores their share."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((1, N_FEATURES))
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = {
        "mean": x.mean(0), "scale": x.std(0) + 1e-6, "W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "w0": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE),
        "c": np.zeros(HIDDEN), "c0": np.array(np.log(share / (1 - share))),
    }
    if len(set(labels.tolist())) < 2:
        return m
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    names = ["W", "w0", "V", "U", "a", "c", "c0"]
    first, second = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}
    scaled = (x - m["mean"]) / m["scale"]
    for step in range(1, epochs + 1):
        f = forward(m, x, starts)
        bag, h, t, s, weight = f["bag"], f["h"], f["t"], f["s"], f["weight"]
        d = (f["score"] - labels) / len(labels)
        dz = (d[:, None] * m["c"])[bag]
        da = (dz * h).sum(1)
        de = weight * (da - np.add.reduceat(weight * da, starts)[bag])
        dg = de[:, None] * m["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (weight[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
        grad = {"W": scaled.T @ dh, "w0": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": f["z"].T @ d, "c0": d.sum()}
        for k in names:
            g = grad[k] + (1e-4 * m[k] if k not in ("w0", "c0") else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            m[k] = m[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model fitted on at most ``sample_docs`` labelled documents, the first by a hash of doc_id.

    Only rows whose crc32(doc_id as text) modulo ``mod`` is not ``held_out`` are used; rows without
    label or doc_id aren't. A document that is labelled twice has the larger label. Of a long text
    SAMPLE_PASSAGES passages, evenly from all of it, speak in the fit, so what the driver gets is
    bounded in bytes too. Null and empty texts are bags of one passage of zeros; rows with equal
    doc_id are bags of their own; without documents or labels the model gives every text the same score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc_mod("doc_id", mod) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    # at most sample_docs rows of two numbers: bounded, so broadcast
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    chosen = ids_and_texts(docs).join(sample, "doc_id").select("doc_id", "y", "text")

    def encode(batches):
        for batch in batches:
            some = lambda x: x if len(x) <= SAMPLE_PASSAGES else x[np.linspace(0, len(x) - 1, SAMPLE_PASSAGES).astype(np.int64)]
            found = [some(x).ravel() for x in passage_features(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = sorted(chosen.mapInArrow(encode, "doc_id long, y int, x array<float>").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["x"]))
    return train([np.array(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows], np.array([r["y"] for r in rows], np.float64))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score``, the model's probability of label 1 from the whole text alone.

    A null text is empty; an empty one has a score too. Rows are scored one by one, so ties and
    repeated rows agree. A column named score is replaced, others pass through.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score")
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for at in range(0, batch.num_rows, 256):
                bags = list(passage_features(batch.column(text).slice(at, 256).cast(pa.string())))
                starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
                out.append(forward(model, np.concatenate(bags).astype(np.float64), starts)["score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "score"])

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)(list(schema.fields)).add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, held_out: int = 0, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``, by a model fitted on ``labels``.

    Null and empty texts, repeated rows and null ids are rows like others; other columns are ignored;
    an empty table gives no rows.
    """
    model = fit(docs, labels, "quality", mod, held_out, sample_docs)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
