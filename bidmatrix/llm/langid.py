"""Language identification with a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes, case folded and with everything but letters blanked, are cut into windows of fixed
length. The network embeds bytes, runs filters of several widths over a window, keeps each filter's highest
response, and ends in a softmax over the languages. A text's probabilities are the mean of its windows',
weighted by the letters they hold, so a text is judged as a whole whatever its length.

It learns from a bounded sample of labelled rows (Training.rows per language, chosen by a hash of their
doc_id, one row per id, and Training.windows windows of each; at most Training.languages languages). Applied, a filter's
response is the sum of a few table look-ups by byte pair, and batches of windows go through at once.

Cases: a null text and one without a letter are `und` with score 0, and so is everything if nothing is
labelled. Rows with null doc_id are judged and not learned from. Repeated rows are judged alike. Very long
texts take many windows and bounded memory. An empty table gives an empty result. Columns of the input named
lang_pred or score are replaced; all others pass through.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship, text_bytes
from bidmatrix.session import stored

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
#: Windows that go through the network together.
TOGETHER = 256
#: Rows of a language that are drawn for each one that is wanted, before the drawn ones are ranked.
SPARE = 4


@dataclass(frozen=True)
class Training:
    rows: int = 400  # labelled rows per language
    windows: int = 4  # windows per row
    languages: int = 200  # the most frequent ones
    steps: int = 600
    batch: int = 64
    rate: float = 0.004
    embedding: int = 8
    filters: int = 16
    seed: int = 7


@dataclass(frozen=True)
class Evidence:
    """What a text must show to count as written in a language."""

    letters: float = 0.2  # share of letters among what is not white space
    above_even: float = 1.05  # score, as a multiple of what even probabilities give


# bytes of a text

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256)], dtype=np.uint8)
_LETTER = re.compile(rb"[A-Za-z]")


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; other ASCII becomes a space."""
    out = _FOLD[data]
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][upper] += 0x20
    return out


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def windows_of(data: np.ndarray) -> np.ndarray:
    """Folded bytes cut into rows of WINDOW, the last filled up with spaces."""
    out = np.full((-(-len(data) // WINDOW), WINDOW), 32, dtype=np.uint8)
    out.reshape(-1)[: len(data)] = fold(data)
    return out


# the network

class Network:
    """Parameters and labels; small enough to send to every task."""

    def __init__(self, labels: list[str], embedding: int, filters: int, seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.labels = labels
        self.weights = {"bytes": draw(256, embedding, scale=0.3)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = draw(w, embedding, filters, scale=(2 / (w * embedding)) ** 0.5)
            self.weights[f"bias{w}"] = np.zeros(filters, np.float32)
        self.weights["out"] = draw(len(WIDTHS) * filters, len(labels), scale=0.1)
        self.weights["offset"] = np.zeros(len(labels), np.float32)

    def tables(self, width: int) -> list[np.ndarray]:
        """Responses of a filter's places to each byte."""
        return [self.weights["bytes"] @ self.weights[f"filter{width}"][j] for j in range(width)]

    def gradients(self, batch: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over windows and the numbers of their labels."""
        pooled, best, rows = [], [], np.arange(len(batch))
        for w in WIDTHS:
            n = batch.shape[1] - w + 1
            response = sum(t[batch[:, j : j + n]] for j, t in enumerate(self.tables(w)))
            best.append(response.argmax(axis=1))
            pooled.append(np.take_along_axis(response, best[-1][:, None], axis=1)[:, 0] + self.weights[f"bias{w}"])
        features = np.maximum(np.concatenate(pooled, axis=1), 0)
        share = softmax(features @ self.weights["out"] + self.weights["offset"])
        share[rows, wanted] -= 1
        share /= len(batch)
        out = {"out": features.T @ share, "offset": share.sum(axis=0), "bytes": np.zeros_like(self.weights["bytes"])}
        back = (share @ self.weights["out"].T) * (features > 0)
        for (w, at), grad in zip(zip(WIDTHS, best), np.split(back, len(WIDTHS), axis=1)):
            out[f"bias{w}"] = grad.sum(axis=0)
            out[f"filter{w}"] = np.zeros_like(self.weights[f"filter{w}"])
            for j in range(w):
                met = batch[rows[:, None], at + j]  # the byte that each filter's best place met
                out[f"filter{w}"][j] = np.einsum("bfe,bf->ef", self.weights["bytes"][met], grad)
                np.add.at(out["bytes"], met, grad[:, :, None] * self.weights[f"filter{w}"][j].T[None])
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], setting: Training = Training()) -> Network:
    """A network for windows (rows of folded bytes) and their labels; languages count alike whatever their number of windows."""
    names = sorted(set(labels))
    network = Network(names, setting.embedding, setting.filters, setting.seed)
    wanted = np.array([names.index(x) for x in labels])
    of = [np.flatnonzero(wanted == k) for k in range(len(names))]
    rng = np.random.default_rng(setting.seed)
    first, second = ({k: np.zeros_like(v) for k, v in network.weights.items()} for _ in range(2))
    for step in range(1, setting.steps + 1):
        picked = np.array([rng.choice(of[k]) for k in rng.integers(len(names), size=setting.batch)])
        rate = setting.rate * (1 - step / (setting.steps + 1))
        for k, g in network.gradients(windows[picked], wanted[picked]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            scaled = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            network.weights[k] -= (rate * scaled).astype(np.float32)
    return network


class Applied:
    """A network made ready for many windows: responses by byte pair."""

    def __init__(self, network: Network):
        self.labels, w = network.labels, network.weights
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        two, three, four = (network.tables(k) for k in WIDTHS)
        self.two, self.three, self.last = pair(*two), pair(*three[:2]), three[2]
        self.four, self.rest = pair(*four[:2]), pair(*four[2:])
        self.bias = np.concatenate([w[f"bias{k}"] for k in WIDTHS])
        self.out, self.offset = w["out"], w["offset"]

    def shares(self, windows: np.ndarray) -> np.ndarray:
        """Probability of each language for each window."""
        found = [self._some(windows[at : at + TOGETHER]) for at in range(0, len(windows), TOGETHER)]
        return np.concatenate(found) if found else np.zeros((0, len(self.labels)), np.float32)

    def _some(self, b: np.ndarray) -> np.ndarray:
        pairs = (b[:, :-1].astype(np.intp) << 8) | b[:, 1:]
        take = lambda t, at: t.take(at, axis=0, mode="clip")
        two = take(self.two, pairs).max(axis=1)
        three = take(self.three, pairs[:, :-1])
        three += take(self.last, b[:, 2:].astype(np.intp))
        four = take(self.four, pairs[:, :-2])
        four += take(self.rest, pairs[:, 2:])
        pooled = np.concatenate([two, three.max(axis=1), four.max(axis=1)], axis=1) + self.bias
        return softmax(np.maximum(pooled, 0) @ self.out + self.offset)


# Spark

def held_out(doc_id: Column) -> Column:
    """Rows that the model never learns from; their accuracy is honest."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, setting: Training = Training()) -> tuple[np.ndarray, list[str]]:
    """Training windows and labels: bounded by the settings and the number of languages."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit(setting.seed))
    ids = stored(known.select("doc_id", "lang").distinct())
    counted = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(setting.languages)
    # the hash alone lets through about SPARE times the rows wanted of each language, so that ranking them is a small job
    thinned = ids.join(stored(counted), "lang")
    thinned = thinned.where(F.pmod(draw, F.lit(2**30)) < F.lit(SPARE * setting.rows * 2.0**30) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.pmod(draw, F.lit(2**30)), draw, "doc_id")
    chosen = thinned.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
    chosen = chosen.where(F.col("place") <= setting.rows).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    starts = [1 + F.pmod(F.xxhash64("doc_id", F.lit(setting.seed + i)), room).cast("int") for i in range(setting.windows)]
    rows = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label")))  # bounded above
    cut = F.array_distinct(F.array(*[F.col("text").substr(s, F.lit(WINDOW)) for s in starts]))
    # of rows that share their id and label, one
    picked = rows.where(F.col("text").isNotNull()).groupBy("id", "label").agg(F.min(cut).alias("cut")).collect()
    # in a fixed order, so that the same rows give the same network
    pairs = sorted((r["label"], c) for r in picked for c in r["cut"] if has_letter(c.encode()))
    windows = [windows_of(np.frombuffer(c.encode(), np.uint8))[0] for _, c in pairs]
    return np.array(windows, dtype=np.uint8).reshape(-1, WINDOW), [label for label, _ in pairs]


def fit(docs: DataFrame, setting: Training = Training()) -> Network | None:
    """A network from docs' labels; None if nothing is labelled."""
    windows, labels = sample(docs, setting)
    return train(windows, labels, setting) if labels else None


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = Applied(sent.value) if sent.value else None
        for batch in batches:
            data, starts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            found = [judge(data[a:b], applied) for a, b in zip(starts[:-1], starts[1:])]
            langs = pa.array([f[0] for f in found], pa.string())
            scores = pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, langs, scores], names=[*batch.schema.names, "lang_pred", "score"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def written(docs: DataFrame, network: Network | None, evidence: Evidence = Evidence()) -> DataFrame:
    """Those of docs, with lang_pred and score, that show a language.

    Gone are null and letterless texts, texts with a smaller share of letters, and, with two languages or more to tell
    apart, those between which the network cannot tell. Without a network the letters alone decide.
    """
    text = F.coalesce("text", F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    shown = (letters > 0) & (letters >= F.lit(evidence.letters) * F.length(F.regexp_replace(text, r"\s", "")))
    if network is None:
        return identify(docs.where(shown), None)
    told = F.col("lang_pred") != UNDETERMINED
    if len(network.labels) > 1:
        told &= F.col("score") >= evidence.above_even / len(network.labels)
    return identify(docs.where(shown), network).where(told)


def judge(data: np.ndarray, applied: Applied | None) -> tuple[str, float]:
    """Language and score of one text's bytes."""
    if applied is None or not has_letter(data.tobytes()):
        return UNDETERMINED, 0.0
    total = np.zeros(len(applied.labels))
    for at in range(0, len(data), WINDOW * TOGETHER):  # whole windows, some at a time
        windows = windows_of(data[at : at + WINDOW * TOGETHER])
        total += (windows != 32).sum(axis=1) @ applied.shares(windows).astype(np.float64)
    best = int(total.argmax())
    return applied.labels[best], float(min(1.0, total[best] / max(total.sum(), 1e-300)))
