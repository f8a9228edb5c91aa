"""Operator 7, language ID: a byte convolutional network, trained in numpy, over fixed-length windows of whole texts.

Filters of several widths slide over the lower-cased UTF-8 bytes of a window, each filter keeps its largest answer, and a
softmax layer reads those. Windows follow each other without gaps to the end of the text; a document's score is the mean of
its windows' probabilities. A filter is a sum of one table look-up a byte, so trained filters are kept as tables over byte
pairs, and inference is gathering, adding and taking maxima: no Python code runs for a single byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest, table
from .tokens import slices

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 12, 8, 256
#: About so many documents of each language are learned from, so many windows of each, and so many languages, the most frequent ones.
LEARN_DOCS, LEARN_WINDOWS, LEARN_LANGUAGES = 400, 4, 256


def windows_of(text: str, size: int = WINDOW) -> np.ndarray:
    """The text's bytes as rows of ``size``, the last one filled up with zeros."""
    raw = text.lower().encode("utf-8", "replace")
    raw += bytes(-len(raw) % size)
    return np.frombuffer(raw, np.uint8).reshape(-1, size)


class ByteCNN:
    """Embedding, filters of ``WIDTHS``, max pooling over a window, rectifier, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        f = FILTERS * len(WIDTHS)
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)), "v": rng.normal(0, 0.2, (f, len(labels))), "c": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)), np.zeros(FILTERS)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Adam on the cross entropy; gradients flow through the places of the maxima only."""
        rng, p = np.random.default_rng(seed), self.p
        m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                rows, pooled, places = np.arange(len(xb)), [], []
                for w in WIDTHS:
                    n = xb.shape[1] - w + 1
                    z = sum((p["e"] @ p[f"w{w}"][k])[xb[:, k : k + n]] for k in range(w))
                    places.append(z.argmax(1))
                    pooled.append(np.take_along_axis(z, places[-1][:, None], 1)[:, 0] + p[f"b{w}"])
                h = np.maximum(np.concatenate(pooled, 1), 0)
                z = h @ p["v"] + p["c"]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[rows, yb] -= 1
                q /= len(xb)
                g = {"v": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
                back = (q @ p["v"].T) * (h > 0)
                for i, w in enumerate(WIDTHS):
                    d = back[:, i * FILTERS : (i + 1) * FILTERS]
                    g[f"b{w}"], g[f"w{w}"] = d.sum(0), np.zeros_like(p[f"w{w}"])
                    for k in range(w):
                        byte = xb[rows[:, None], places[i] + k]
                        g[f"w{w}"][k] = np.einsum("bf,bfe->ef", d, p["e"][byte])
                        np.add.at(g["e"], byte.ravel(), (d[:, :, None] * p[f"w{w}"][k].T[None]).reshape(-1, EMBED))
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def compile(self) -> dict:
        """The filters as tables over two bytes at a time; the parts of all widths that read the same two bytes lie side by side."""
        p, tables = self.p, []
        for at in range(0, max(WIDTHS), 2):
            parts = []
            for w in (w for w in WIDTHS if w > at):
                one = p["e"] @ p[f"w{w}"][at]
                two = p["e"] @ p[f"w{w}"][at + 1] if w > at + 1 else np.zeros_like(one)
                parts.append((one[None, :] + two[:, None]).reshape(65536, FILTERS))  # a pair's number: first byte + 256 * second
            tables.append(np.ascontiguousarray(np.concatenate(parts, 1), np.float32))
        bias = np.concatenate([p[f"b{w}"] for w in WIDTHS]).astype(np.float32)
        return {"tables": tables, "bias": bias, "v": p["v"].astype(np.float32), "c": p["c"].astype(np.float32), "labels": self.labels}


def probabilities(model: dict, x: np.ndarray, step: int = 32) -> np.ndarray:
    """Softmax answers for windows of bytes, ``step`` windows at a time so that what is gathered stays in the cache."""
    out, (first, *others) = np.empty((len(x), len(model["labels"])), np.float32), model["tables"]
    wide = max(WIDTHS)
    for at in range(0, len(x), step):
        b = x[at : at + step]
        b = np.concatenate([b, np.zeros((len(b), wide), np.uint8)], 1).astype(np.int32)
        pairs = b[:, :-1] + (b[:, 1:] << 8)
        n = x.shape[1] - 1
        z = first[pairs[:, :n]]
        for i, more in enumerate(others, 1):
            z[:, :, -more.shape[1] :] += more[pairs[:, 2 * i : 2 * i + n]]
        h = np.maximum(z.max(1) + model["bias"], 0)
        q = h @ model["v"] + model["c"]
        q = np.exp(q - q.max(1, keepdims=True))
        out[at : at + step] = q / q.sum(1, keepdims=True)
    return out


def lessons(text: str, size: int = WINDOW, per_doc: int = LEARN_WINDOWS) -> list[bytes]:
    """Up to ``per_doc`` windows of a whole text, evenly spread, and its first words alone, as short texts are to be known too."""
    w = windows_of(text, size)
    take = np.unique(np.linspace(0, len(w) - 1, min(per_doc, len(w))).astype(int)) if len(w) else []
    return [w[i].tobytes() for i in take] + [w[0, :40].tobytes() + bytes(size - 40) for _ in take[:1] if len(text) > 40]


def train(rows: list[tuple[bytes, str]]) -> dict | None:
    """A compiled model from (window, language) rows; None if there is nothing to learn from."""
    if not rows:
        return None
    labels = sorted({lang for _, lang in rows})
    x = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(len(rows), -1)
    return ByteCNN(labels).fit(x, np.array([labels.index(lang) for _, lang in rows])).compile()


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its score of every whole text; ``und`` and 0 without a letter, a text or a model."""
    known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if known:
        rows = [windows_of(texts[i]) for i in known]
        q = probabilities(model, np.concatenate(rows))
        mass = np.concatenate([np.count_nonzero(r > 64, axis=1) for r in rows]) + 1.0  # a window counts by its letters
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        mean = np.add.reduceat(q * mass[:, None], starts) / np.add.reduceat(mass, starts)[:, None]
        for i, m in zip(known, mean):
            lang[i], score[i] = model["labels"][int(m.argmax())], float(m.max())
    return lang, score


def held_out() -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1


def learn(docs: DataFrame, per_language: int = LEARN_DOCS, most_languages: int = LEARN_LANGUAGES) -> dict | None:
    """Trains on about ``per_language`` documents of each language, for the ``most_languages`` languages with the most documents (ties by name).

    Only rows with text, language and doc_id whose crc32(doc_id) mod 3 is not 1 are learned from. Languages are counted; then a
    row is learned from if a hash of its id and text falls below the share of its language that ``per_language`` rows are, so no task
    gathers a language. At most LEARN_WINDOWS + 1 windows of each chosen text come to the driver, equal ones once. Repeated
    rows are chosen alike and count once; no rows to learn from give None."""
    usable = docs.where(~F.coalesce(held_out(), F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def run(batches):
        for batch in batches:
            made = [(w, lang) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in lessons(text)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in made], pa.binary()), pa.array([lang for _, lang in made], pa.string())], names=["w", "lang"])

    few = usable.where(draw < F.element_at(shares, F.col("lang"))).select("text", "lang").mapInArrow(run, "w binary, lang string").distinct()
    return train(sorted((bytes(r.w), r.lang) for r in few.collect()))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (columns of these names are replaced), one row per row.

    A null or letterless text gives ``und`` and score 0, as does every text if there was nothing to learn from. Long texts are
    read to their end. Repeated rows are answered each; an empty table gives no rows."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    box = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                lang, score = predict(box.value, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return modest(docs).mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
