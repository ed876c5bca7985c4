"""Language identification with a convolutional network over bytes.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
window of fixed length and classified by a softmax layer. The whole text counts:
it is cut into consecutive windows, and the mean of their log-probabilities,
weighted by length, is the document's. Trained in numpy with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import append_columns, least_hashed, raw_texts

UNKNOWN = "und"
HELD_OUT = 2


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 4


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row is in the held-out fold; one without an id is in none."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


@dataclass
class Settings:
    """window: bytes; widths, filters: of the convolution; samples: labelled rows
    that training may see; windows: of the windows of their whole texts, how many."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embedding: int = 6
    samples: int = 3000
    windows: int = 12000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    settings: Settings
    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray  # (widest * embedding, all filters); narrower filters are zero at the end
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows, the last padded with 0, and their lengths."""
    n = max(1, -(-len(raw) // size))
    data = np.zeros(n * size, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    lengths = np.full(n, size, np.float32)
    lengths[-1] = max(1, len(raw) - (n - 1) * size)
    return data.reshape(n, size), lengths


def _columns(net: Network, data: np.ndarray) -> np.ndarray:
    """(windows, positions, widest * embedding): each position with those after it."""
    widest = max(net.settings.widths)
    x = net.embed[data]
    view = np.lib.stride_tricks.sliding_window_view(x, widest, axis=1)  # windows, positions, embedding, widest
    return view.transpose(0, 1, 3, 2).reshape(len(data), view.shape[1], -1)


def pair_tables(net: Network) -> list[np.ndarray]:
    """What each pair of bytes adds to every filter, for each two of the widest
    filter's places: the convolution of a window is then a sum of table rows."""
    widest, d = max(net.settings.widths), net.settings.embedding
    places = (net.filters.reshape(widest, d, -1)[i] for i in range(widest))
    by_byte = [net.embed @ w for w in places] + [np.zeros((256, net.filters.shape[1]), np.float32)] * (widest % 2)
    return [(a[:, None] + b[None]).reshape(65536, -1).astype(np.float32) for a, b in zip(by_byte[0::2], by_byte[1::2])]


def log_probabilities(net: Network, data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    widest = max(net.settings.widths)
    n = data.shape[1] - widest + 1
    data = np.pad(data, ((0, 0), (0, widest % 2)))  # an odd width's last table ignores its second byte
    pairs = data[:, :-1].astype(np.intp) * 256 + data[:, 1:]
    pooled = np.empty((len(data), net.filters.shape[1]), np.float32)
    for at in range(0, len(data), 16):  # few windows at a time stay in the cache
        rows = pairs[at : at + 16]
        z = tables[0].take(rows[:, :n].ravel(), 0, mode="clip")
        for k, table in enumerate(tables[1:], 1):
            z += table.take(rows[:, 2 * k : 2 * k + n].ravel(), 0, mode="clip")
        z, left = z.reshape(len(rows), n, -1), n
        while left > 1:
            half = (left + 1) // 2
            z, left = np.maximum(z[:, :half], z[:, left - half : left]), half
        pooled[at : at + 16] = z[:, 0]
    z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(texts: list[bytes], labels: list[str], settings: Settings) -> Network:
    """Fits the network to all windows of texts; with no rows it knows no language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(settings.seed)
    widest, d = max(settings.widths), settings.embedding
    n_filters = settings.filters * len(settings.widths)
    mask = np.zeros((widest, d, n_filters), np.float32)
    for i, w in enumerate(settings.widths):
        mask[:w, :, i * settings.filters : (i + 1) * settings.filters] = 1
    mask = mask.reshape(widest * d, n_filters)
    init = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(settings, languages, init(256, d, scale=0.7), init(widest * d, n_filters) * mask, np.zeros(n_filters, np.float32), init(n_filters, len(languages)), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return net
    data, target = [], []
    for raw, label in zip(texts, labels):
        data.append(windows_of(raw, settings.window)[0])
        target += [languages.index(label)] * len(data[-1])
    data, target = np.concatenate(data), np.array(target)
    names = ("embed", "filters", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            x = _columns(net, data[rows])
            z = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(*x.shape[:2], -1)
            where = z.argmax(1)
            best = np.take_along_axis(z, where[:, None], 1)[:, 0] + net.bias
            pooled = np.maximum(best, 0)
            p = pooled @ net.out + net.out_bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p /= len(rows)
            back = (p @ net.out.T) * (best > 0)
            grad = {"out": pooled.T @ p, "out_bias": p.sum(0), "bias": back.sum(0)}
            chosen = np.take_along_axis(x, where[:, :, None], 1)  # rows, filters, widest * embedding
            grad["filters"] = np.einsum("rfi,rf->if", chosen, back) * mask
            dx = (back[:, :, None] * net.filters.T[None]).reshape(len(rows), n_filters, widest, d)
            at_byte = data[rows][np.arange(len(rows))[:, None, None], where[:, :, None] + np.arange(widest)]
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], at_byte.ravel(), dx.reshape(-1, d))
            step += 1
            rate = settings.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                setattr(net, k, (getattr(net, k) - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32))
    return net


def fit(docs: DataFrame, settings: Settings = Settings()) -> Network:
    """A network from at most settings.samples rows with text and lang outside the
    held-out fold, those with the least xxhash64 of the id.

    Their whole texts are cut into windows as in prediction; of more than
    settings.windows, those with the least hash of id and place count, so every
    part of a text has the same chance.
    """
    size = settings.window
    rows = docs.where((fold() != HELD_OUT) & F.col("lang").isNotNull())
    total = rows.count()  # reads no text
    rows = least_hashed(rows.where(F.length("text") > 0).select("doc_id", "lang", "text"), total, settings.samples, "lang", "text")
    raw = F.encode("text", "utf-8")
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / size).cast("int"))
    cuts = rows.withColumn("raw", raw).select("doc_id", "lang", F.posexplode(F.transform(places, lambda i: F.substring(F.col("raw"), i * size + 1, F.lit(size)))).alias("place", "cut"))
    cuts = cuts.orderBy(F.xxhash64("doc_id", "place"), "lang", "cut").limit(settings.windows).collect()
    return train([bytes(r["cut"]) for r in cuts], [r["lang"] for r in cuts], settings)


def predict(docs: DataFrame, net: Network, prefix: str = "", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score (0 to 1), behind prefix.

    A null or empty text, one in which no character is a letter (str.isalpha),
    and any text if the network knows no language, is ``und`` with score 0. Equal
    texts get equal rows, however long; a table without rows gives none. A column
    of docs whose name is that of a new column is replaced.
    """
    fields = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]
    size, block = net.settings.window, 256

    def make():
        tables = pair_tables(net)

        def step(batch):
            raws = raw_texts(batch)
            names, scores = [UNKNOWN] * len(raws), [0.0] * len(raws)
            rows = [i for i, raw in enumerate(raws) if net.languages and any(map(str.isalpha, raw.decode()))]
            total = np.zeros((len(raws), len(net.languages)))
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush():
                logp = log_probabilities(net, np.concatenate([w for _, w, _ in held]), tables)
                weight = np.concatenate([n for _, _, n in held])
                np.add.at(total, np.repeat([i for i, _, _ in held], [len(n) for _, _, n in held]), logp * weight[:, None] / size)
                held.clear()

            waiting = 0
            for i in rows:
                data, lengths = windows_of(raws[i], size)
                for at in range(0, len(data), block):
                    held.append((i, data[at : at + block], lengths[at : at + block]))
                    waiting += len(held[-1][1])
                    if waiting >= block:
                        flush()
                        waiting = 0
            if held:
                flush()
            if rows:
                mean = total[rows] / np.maximum(1, [len(raws[i]) / size for i in rows])[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, k, x in zip(rows, p.argmax(1).tolist(), p.max(1).tolist()):
                    names[i], scores[i] = net.languages[k], x
            return [names, scores]

        return step

    return append_columns(docs, fields, make, () if keep_text else ("text",))
