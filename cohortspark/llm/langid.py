"""Language of texts by a small byte convolutional network.

Bytes are embedded; filters of several widths slide over windows of fixed length, the maximum of each filter over
a window goes into a softmax. Training is numpy on the driver, over a bounded sample of labelled windows;
prediction runs over every window of every text, and a text's probabilities are the mean over its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import free_names, map_batches, with_columns

LENGTH = 256  # bytes in a window
WIDTHS = (2, 3, 4)
EMBEDDED, FILTERS = 6, 16
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    """Weights; `filters` holds the filters of all widths, those of less than the greatest width end in zeros."""

    embedding: np.ndarray  # (256, EMBEDDED); byte 0 pads and is zero
    filters: np.ndarray  # (greatest width * EMBEDDED, widths * FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (widths * FILTERS, languages)
    out_bias: np.ndarray
    languages: list[str]

    def features(self, windows: np.ndarray, at: bool = False):
        """Maximum of each filter over each window (rows of bytes), and where it is."""
        n, widest = len(windows), max(WIDTHS)
        padded = np.zeros((n, LENGTH + widest - 1), np.uint8)
        padded[:, :LENGTH] = windows
        grams = np.lib.stride_tricks.sliding_window_view(padded, widest, axis=1)
        inputs = self.embedding[grams].reshape(n * LENGTH, -1)
        answers = (inputs @ self.filters).reshape(n, LENGTH, -1)
        if not at:
            return np.maximum(answers.max(axis=1) + self.bias, 0)
        where = answers.argmax(axis=1)
        best = np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0] + self.bias
        return np.maximum(best, 0), where, grams

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), batch):
            out[i : i + batch] = softmax(self.features(windows[i : i + batch]) @ self.out + self.out_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(data: bytes) -> np.ndarray:
    """A text's windows, without overlap; the last is padded with zero bytes."""
    rows = max(1, -(-len(data) // LENGTH))
    out = np.zeros(rows * LENGTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, LENGTH)


def train(texts: list[str], labels: list[str], epochs: int = 5, rate: float = 0.01, seed: int = 11) -> Network:
    """A network fitted by Adam to texts of at most a window; the order of the rows and the seed fix the result."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    mask = np.zeros((max(WIDTHS) * EMBEDDED, total), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBEDDED, k * FILTERS : (k + 1) * FILTERS] = 1
    draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = Network(
        draw(256, EMBEDDED) * 0.5, draw(len(mask), total) * 0.3 * mask, np.zeros(total, np.float32),
        draw(total, len(languages)) * 0.1, np.zeros(len(languages), np.float32), languages,
    )
    net.embedding[0] = 0
    data = np.concatenate([cut_windows(t.encode()[:LENGTH]) for t in texts])
    wanted = np.array([languages.index(x) for x in labels])
    weights = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(data), 64):
            rows = order[i : i + 64]
            values, where, grams = net.features(data[rows], at=True)
            error = softmax(values @ net.out + net.out_bias)
            error[np.arange(len(rows)), wanted[rows]] -= 1
            error /= len(rows)
            back = (error @ net.out.T) * (values > 0)
            chosen = grams[np.arange(len(rows))[:, None], where]  # (rows, filters, widest) bytes under each maximum
            inputs = net.embedding[chosen].reshape(len(rows), total, -1)
            d_filters = np.einsum("rf,rfi->if", back, inputs) * mask
            d_inputs = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDED)
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, chosen.reshape(-1), d_inputs)
            d_embedding[0] = 0
            step += 1
            for w, g, m, v in zip(
                weights, [d_embedding, d_filters, back.sum(0), values.T @ error, error.sum(0)], first, second
            ):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(id_column: Column) -> Column:
    """True for a fifth of the ids, by the checksum of the id as text."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def fit(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    per_label: int = 400,
    most: int = 20_000,
) -> Network | None:
    """A network from labelled rows; None without any.

    About `per_label` rows of each label are drawn by a hash of the id (rarer labels: all), at most `most` in all;
    each gives up to three windows, from its start, middle and end. That sample is all that reaches the driver.
    """
    chars = LENGTH
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(10**12)) < share[F.col("label")] * 10**12
    n = F.length("text")
    cuts = F.array_distinct(F.array(F.lit(1), F.greatest(F.lit(1), n / 2).cast("int"), F.greatest(F.lit(1), n - chars)))
    rows = rows.where(drawn).withColumn("at", F.explode(cuts))
    rows = rows.select("id", "label", F.substr("text", "at", F.lit(chars)).alias("text"))
    sample = rows.orderBy(F.xxhash64("id", "text"), "id", "text").limit(most).collect()
    return train([r.text for r in sample], [r.label for r in sample])


def predictions(net: Network | None, texts: list) -> tuple[list[str], list[float]]:
    """Language and probability of each text, from all of its windows."""
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    found = [i for i, t in enumerate(texts) if t is not None and net is not None and LETTER.search(t)]
    for begin in range(0, len(found), 16):
        some = found[begin : begin + 16]
        cuts = [cut_windows(texts[i].encode()) for i in some]
        each = net.probabilities(np.concatenate(cuts))
        size = np.concatenate([(c != 0).sum(axis=1) for c in cuts])
        ends = np.cumsum([0] + [len(c) for c in cuts])[:-1]
        mean = np.add.reduceat(each * size[:, None], ends) / np.maximum(np.add.reduceat(size, ends), 1)[:, None]
        best = mean.argmax(axis=1)
        for i, k, row in zip(some, best, mean):
            languages[i], scores[i] = net.languages[k], float(min(1.0, max(0.0, row[k])))
    return languages, scores


def predict(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; `und` with score 0 where it is null or has no letter.

    Only the id and the text are read. Repeated rows give repeated results; without a network all is `und`.
    """

    def run(batch):
        return batch.column(0), *predictions(net, batch.column(1).to_pylist())

    schema = f"doc_id {id_type(docs, id_column)}, lang_pred string, score double"
    return map_batches(docs, [id_column, text], run, schema)


def known(docs: DataFrame, net: Network | None, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose text has a language: not `und`, and a probability of `least` or more. All columns stay.

    Null and empty texts and texts without a letter have no language and go; repeated rows stay or go together; an
    empty table gives no row.
    """
    lang, score = free_names(docs, "_lang_pred", "_lang_score")
    marked = with_columns(docs, [text], lambda x: predictions(net, x[0]), f"{lang} string, {score} double")
    return marked.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
