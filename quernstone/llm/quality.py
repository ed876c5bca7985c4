"""Quality classification with a factorisation machine.

Features are hashed words (relative counts), statistics of structure and the
length as metadata. Every feature has a weight and a short vector; the score adds
the weights and, for every pair of features, the product of their vectors, which
half of (square of the sum - sum of the squares) gives in linear time.
Trained in numpy with Adam on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import append_columns, least_hashed, map_batches, raw_texts, slices
from quernstone.llm.fastbytes import PowerTable, word_hashes
from quernstone.llm.langid import HELD_OUT, fold

THRESHOLD = 0.7


@dataclass
class Settings:
    """samples: labelled rows that training may see; buckets: of hashed words;
    rank: length of the vectors."""

    samples: int = 4000
    buckets: int = 2048
    rank: int = 6
    epochs: int = 30
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Machine:
    settings: Settings
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


#: Classes of bytes whose shares are statistics.
CLASSES = [
    np.arange(0x61, 0x7B),
    np.arange(0x41, 0x5B),
    np.arange(0x30, 0x3A),
    np.array([0x20]),
    np.array([0x0A]),
    np.frombuffer(b".,;:!?'\"()-", np.uint8),
    np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8),
    np.arange(0x80, 0x100),
]
STATISTICS = len(CLASSES) + 9


def statistics(raw: bytes, words: np.ndarray) -> np.ndarray:
    """Structure of a text; all 0 but the constant for an empty one."""
    out = np.zeros(STATISTICS)
    out[-1] = 1
    if not raw:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count / len(raw)
    out[: len(CLASSES)] = [share[c].sum() for c in CLASSES]
    lines = raw.split(b"\n")
    some = share[share > 0]
    distinct, times = np.unique(words, return_counts=True) if len(words) else (words, np.zeros(1, np.int64))
    out[len(CLASSES) : -1] = [
        np.log1p(len(raw) - int(count[0x80:0xC0].sum())),  # the length in code points
        np.log1p(len(words)),
        len(distinct) / max(1, len(words)),
        times.max() / max(1, len(words)),
        len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)),
        len(raw) / max(1, len(words)) / 10,
        -(some * np.log(some)).sum(),
    ]
    return out


def features(raw: bytes, buckets: int, table: PowerTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, and the buckets and square roots of shares of hashed words."""
    words = word_hashes(raw, table)
    if not len(words):
        return statistics(raw, words), np.empty(0, np.int64), np.empty(0)
    count = np.bincount((words % np.uint64(buckets)).astype(np.intp), minlength=buckets)
    places = np.flatnonzero(count)
    return statistics(raw, words), places, np.sqrt(count[places] / len(words))


def train(stats: np.ndarray, words: np.ndarray, labels: np.ndarray, settings: Settings) -> Machine:
    """Fits the machine to dense rows; without both labels it always gives their mean."""
    rng = np.random.default_rng(settings.seed)
    size = STATISTICS + settings.buckets
    mean, spread = (stats.mean(0), np.maximum(stats.std(0), 1e-3)) if len(stats) else (np.zeros(STATISTICS), np.ones(STATISTICS))
    rate_of_1 = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(settings, mean, spread, float(np.log(rate_of_1 / (1 - rate_of_1))), np.zeros(size), rng.normal(0, 0.02, (size, settings.rank)))
    if len(set(labels.tolist())) < 2:
        machine.vectors[:] = 0
        return machine
    x = np.hstack([(stats - mean) / spread, words])
    params = {"bias": np.array([machine.bias]), "weights": machine.weights, "vectors": machine.vectors}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), settings.batch):
            rows = x[order[at : at + settings.batch]]
            v = params["vectors"]
            sums = rows @ v
            z = params["bias"][0] + rows @ params["weights"] + 0.5 * ((sums**2).sum(1) - (rows**2) @ (v**2).sum(1))
            back = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[order[at : at + settings.batch]]) / len(rows)
            grad = {
                "bias": np.array([back.sum()]),
                "weights": rows.T @ back + settings.decay * params["weights"],
                "vectors": rows.T @ (back[:, None] * sums) - v * ((rows**2).T @ back)[:, None] + settings.decay * v,
            }
            step += 1
            for k, p in params.items():
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                p -= settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(params["bias"][0])
    return machine


def score_of(machine: Machine, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """The sum-of-squares identity over the features that are there."""
    stats, places, shares = found
    x = np.concatenate([(stats - machine.mean) / machine.spread, shares])
    rows = np.concatenate([np.arange(STATISTICS), STATISTICS + places])
    v = machine.vectors[rows]
    z = machine.bias + machine.weights[rows] @ x + 0.5 * (((x @ v) ** 2).sum() - (x**2) @ (v**2).sum(1))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """A machine from at most settings.samples labelled documents outside the
    held-out fold, those with the least xxhash64 of the id. Their whole texts
    count; only their features reach the driver. Rows of one id are one document,
    with the least of their texts; repeated labels count once. Without rows the
    machine gives every text the same score."""
    chosen = labels.where((fold() != HELD_OUT) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    chosen = least_hashed(chosen, chosen.count(), settings.samples, "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    buckets = settings.buckets

    def run(batches):
        table = PowerTable()
        for batch in slices(batches):
            found = [features(raw, buckets, table) for raw in raw_texts(batch)]
            columns = [[f[i].tolist() for f in found] for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.list_(pa.float64())), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.float64()))], names=["doc_id", "label", "stats", "places", "shares"])

    got = map_batches(rows, run, "doc_id long, label int, stats array<double>, places array<long>, shares array<double>")
    got = sorted(got.collect(), key=lambda r: (r["doc_id"], r["label"], r["stats"]))
    words = np.zeros((len(got), buckets))
    for row, r in zip(words, got):
        row[r["places"]] = r["shares"]
    return train(np.array([r["stats"] for r in got]).reshape(-1, STATISTICS), words, np.array([r["label"] for r in got], float), settings)


def score(docs: DataFrame, machine: Machine, prefix: str = "", keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1, that the label is 1) and predicted (1 from 0.7 on),
    behind prefix.

    A null text is empty, and an empty text has the score of its statistics.
    Equal texts get equal scores, however long; a table without rows gives none. A
    column of docs whose name is that of a new column is replaced.
    """
    fields = [T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())]
    buckets = machine.settings.buckets

    def make():
        table = PowerTable()

        def step(batch):
            found = [score_of(machine, features(raw, buckets, table)) for raw in raw_texts(batch)]
            return [found, [int(x >= THRESHOLD) for x in found]]

        return step

    return append_columns(docs, fields, make, () if keep_text else ("text",))
