"""Toxicity by a linear-chain conditional random field over the words of a text.

Words are tagged toxic or not. A word's evidence are its own form, its beginnings and endings, and its
neighbours, hashed into a table of weights; neighbouring tags depend on each other. A chain is a sentence;
one of more than CHAIN words goes on in the next chain. Forward-backward gives every word's marginal
probability of being toxic, and a document's score follows from its words' marginals: the highest, their
sum and their density, weighed by a logistic curve fitted to labelled documents. Runs of words with a
marginal of one half or more are the offending spans, by code point.

Labels are per document. The labelled words that the field learns from are derived from them: a word of a toxic
document is toxic if its form, or a beginning or ending of it, turns up in toxic documents far more often
than in others (log odds and standard errors are parameters), and words of other documents are not.

It learns from a bounded sample of different labelled texts (Training.toxic and Training.other rows), chosen by
a hash of the text: the field from a window of Training.chars of each, near copies counted once, the curve from
the whole texts. Applied, every word of every text is tagged.

Cases: null and empty texts have no words and get the score of such. Texts with the same words get the same
score. A label is the largest of its document's; null ids and labels teach nothing; without any label all scores
are 0. Very long texts take many chains and memory in proportion to one text. An empty table gives an empty
result. Columns of the input named score, predicted or spans are replaced; all others pass through.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship, text_pieces, word_spans
from bidmatrix.session import stored

CHAIN = 64
#: Weights of the field: hashed forms share them.
BITS = 18
PREFIXES = (4, 5, 6, 7, 8, 10)
SUFFIXES = (3, 4, 5)
#: Kinds of evidence a word gives by itself; the two neighbours come after them.
OWN = 1 + len(PREFIXES) + len(SUFFIXES)
#: Rows of a class that are drawn for each one that is wanted, before the drawn ones are ranked.
SPARE = 4


@dataclass(frozen=True)
class Training:
    toxic: int = 1500  # different texts labelled toxic
    other: int = 3000
    chars: int = 8000  # of a text, for the field
    odds: float = 2.5  # of a form, for its words to be toxic: at least this log odds ratio
    errors: float = 3.0  # and as many standard errors
    steps: int = 400
    batch: int = 1000  # chains of a step
    rate: float = 0.2
    decay: float = 1e-4
    seed: int = 5


# words, chains and their evidence

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_ENDS = np.array([chr(c) in ".!?\n" for c in range(256)])
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters."""
    out = _LOWER[data]
    upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][upper] += 0x20
    return out


class SpanHash:
    """Hashes of any spans of some bytes, equal for equal bytes, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        powers = lambda base: np.concatenate([[np.uint64(1)], np.full(len(data), base, np.uint64)]).cumprod(dtype=np.uint64)
        weighed = (data.astype(np.uint64) + np.uint64(1)) * powers(np.uint64(_BASE))[:-1]
        self.sums = np.concatenate([[np.uint64(0)], weighed.cumsum(dtype=np.uint64)])
        self.back = powers(np.uint64(pow(_BASE, -1, 2**64)))

    def of(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """Places in a table of 2**BITS for spans of one kind of evidence."""
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts] + np.uint64((kind + 1) * _MIX % 2**64)
        raw ^= raw >> np.uint64(29)
        return ((raw * np.uint64(_MIX)) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Words:
    """Words of some texts: where they lie, whose they are, their chains, and their evidence (-1: none)."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    chain: np.ndarray  # number of each word's chain, rising
    place: np.ndarray  # in the chain
    evidence: np.ndarray = field(repr=False)  # (kinds, words)


def words_of(data: np.ndarray, cuts: np.ndarray) -> Words:
    starts, ends, text = word_spans(data, cuts)
    data = lowered(data)
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])[starts]
    first = np.flatnonzero(np.concatenate([[True], (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])])) if len(starts) else starts
    sizes = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, sizes)
    chain = np.cumsum((place % CHAIN) == 0) - 1
    hashes, kinds = SpanHash(data), []
    kinds.append(hashes.of(starts, ends, 0))
    length = ends - starts
    for k, n in enumerate(PREFIXES, 1):
        kinds.append(np.where(length >= n, hashes.of(starts, np.minimum(starts + n, ends), k), -1))
    for k, n in enumerate(SUFFIXES, 1 + len(PREFIXES)):
        kinds.append(np.where(length >= n, hashes.of(np.maximum(ends - n, starts), ends, k), -1))
    near = np.full((2, len(starts)), -1, np.int32)
    if len(starts) > 1:
        together = chain[1:] == chain[:-1]
        near[0, 1:] = np.where(together, hashes.of(starts[:-1], ends[:-1], OWN), -1)
        near[1, :-1] = np.where(together, hashes.of(starts[1:], ends[1:], OWN + 1), -1)
    return Words(starts, ends, text, chain, place % CHAIN, np.concatenate([np.array(kinds, np.int32).reshape(OWN, -1), near]))


# the field

@dataclass
class Chains:
    """Words laid out by place and chain, the longest chain first."""

    order: np.ndarray  # column of each chain
    alive: np.ndarray  # chains with a word at each place
    place: np.ndarray
    column: np.ndarray  # of each word

    @staticmethod
    def of(chain: np.ndarray, place: np.ndarray) -> "Chains":
        sizes = np.bincount(chain) if len(chain) else np.zeros(0, int)
        order = np.argsort(-sizes, kind="stable")
        column = np.empty_like(order)
        column[order] = np.arange(len(order))
        alive = np.array([np.searchsorted(-sizes[order], -t, "left") for t in range(int(sizes.max(initial=0)))])
        return Chains(column, alive, place, column[chain] if len(chain) else place)


@dataclass
class Field:
    """Weights of the evidence for toxic, and of tags that start, follow each other and end."""

    weights: np.ndarray
    follow: np.ndarray  # (2, 2)
    start: np.ndarray  # (2,)
    end: np.ndarray

    def evidence(self, words: Words) -> np.ndarray:
        table = np.append(self.weights, np.float32(0))  # -1 reads the last
        out = np.zeros(len(words.starts))
        for kind in words.evidence:
            out += table[kind]
        return out

    def marginals(self, evidence: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Each word's probability of being toxic; those of the four pairs of tags of words that follow each other,
        (2, 2), and of tags at starts and ends, (2, 2), summed; and the log of all chains' weights, summed."""
        length, width = len(chains.alive), len(chains.order)
        e = np.zeros((length, width))
        e[chains.place, chains.column] = evidence
        ahead, behind = np.zeros((2, length, width)), np.zeros((2, length, width))
        for t, n in enumerate(chains.alive):
            if t == 0:
                ahead[0, 0], ahead[1, 0] = self.start[0], self.start[1] + e[0]
                continue
            for s in (0, 1):
                ahead[s, t, :n] = np.logaddexp(ahead[0, t - 1, :n] + self.follow[0, s], ahead[1, t - 1, :n] + self.follow[1, s])
            ahead[1, t, :n] += e[t, :n]
        pairs = np.zeros((2, 2))
        for t in range(length - 1, -1, -1):
            n, later = chains.alive[t], chains.alive[t + 1] if t + 1 < length else 0
            for s in (0, 1):
                behind[s, t, later:n] = self.end[s]
                if later:
                    behind[s, t, :later] = np.logaddexp(
                        behind[0, t + 1, :later] + self.follow[s, 0], behind[1, t + 1, :later] + self.follow[s, 1] + e[t + 1, :later]
                    )
        total = np.logaddexp(ahead[0, 0] + behind[0, 0], ahead[1, 0] + behind[1, 0]) if length else np.zeros(0)
        for t in range(1, length):
            n = chains.alive[t]
            for r in (0, 1):
                for s in (0, 1):
                    here = ahead[r, t - 1, :n] + self.follow[r, s] + s * e[t, :n] + behind[s, t, :n]
                    pairs[r, s] += np.exp(here - total[:n]).sum()
        toxic = np.exp(ahead[1] + behind[1] - total) if length else np.zeros((0, 0))
        at_start = toxic[0].sum() if length else 0.0
        lasts = chains.alive - np.append(chains.alive[1:], 0) if length else chains.alive
        at_end = sum(toxic[t, chains.alive[t] - k : chains.alive[t]].sum() for t, k in enumerate(lasts))
        ends = np.array([[width - at_start, at_start], [width - at_end, at_end]])
        return toxic[chains.place, chains.column], pairs, ends, float(total.sum())

    def tag(self, words: Words) -> np.ndarray:
        """Marginals alone, in fewer steps."""
        return self.marginals_only(self.evidence(words), Chains.of(words.chain, words.place))

    def marginals_only(self, evidence: np.ndarray, chains: Chains) -> np.ndarray:
        """As ``marginals``, by log odds: how much likelier toxic is from what lies ahead of a word, and behind it."""
        length, width = len(chains.alive), len(chains.order)
        e = np.zeros((length, width))
        e[chains.place, chains.column] = evidence
        ahead, behind = np.zeros((length, width)), np.zeros((length, width))
        step = lambda odds, m: np.logaddexp(m[0, 1], m[1, 1] + odds) - np.logaddexp(m[0, 0], m[1, 0] + odds)
        for t, n in enumerate(chains.alive):
            ahead[t, :n] = e[t, :n] + (step(ahead[t - 1, :n], self.follow) if t else self.start[1] - self.start[0])
        for t in range(length - 1, -1, -1):
            n, later = chains.alive[t], chains.alive[t + 1] if t + 1 < length else 0
            behind[t, later:n] = self.end[1] - self.end[0]
            if later:
                behind[t, :later] = step(behind[t + 1, :later] + e[t + 1, :later], self.follow.T)
        odds = ahead[chains.place, chains.column] + behind[chains.place, chains.column]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def field_of(words: Words, tags: np.ndarray, setting: Training = Training()) -> Field:
    """A field of greatest likelihood, with weights held small, for words and their tags."""
    out = Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    names = ("weights", "follow", "start", "end")
    squares = {k: np.full_like(getattr(out, k), 1e-6) for k in names}
    rng = np.random.default_rng(setting.seed)
    n_chains = int(words.chain[-1]) + 1 if len(words.chain) else 0
    begins = np.searchsorted(words.chain, np.arange(n_chains + 1))
    for _ in range(setting.steps if n_chains else 0):
        picked = np.sort(rng.choice(n_chains, min(setting.batch, n_chains), replace=False))
        sizes = begins[picked + 1] - begins[picked]
        these = np.repeat(begins[picked] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        for k, g in gradients(out, words.evidence[:, these], tags[these], np.repeat(np.arange(len(picked)), sizes), words.place[these]).items():
            g += setting.decay * getattr(out, k) * len(picked)
            squares[k] += g * g
            setattr(out, k, getattr(out, k) - (setting.rate * g / np.sqrt(squares[k])).astype(squares[k].dtype))
    return out


def gradients(model: Field, evidence: np.ndarray, tags: np.ndarray, chain: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Of the negative log likelihood of some chains' tags."""
    table = np.append(model.weights, np.float32(0))
    toxic, pairs, ends, _ = model.marginals(table[evidence].sum(axis=0, dtype=np.float64), Chains.of(chain, place))
    off = toxic - tags
    out = np.zeros(len(model.weights) + 1)
    for kind in evidence:
        out += np.bincount(np.where(kind < 0, len(model.weights), kind), off, len(out))
    inner, seen = place[1:] > 0, np.zeros((2, 2))
    np.add.at(seen, (tags[:-1][inner], tags[1:][inner]), 1)
    last = np.append(~inner, True)
    at = lambda mask: np.bincount(tags[mask], minlength=2)
    return {"weights": out[:-1].astype(np.float32), "follow": pairs - seen, "start": ends[0] - at(place == 0), "end": ends[1] - at(last)}


# labelled words from labelled documents

def different(words: Words, n_texts: int) -> np.ndarray:
    """Which texts are no near copy of an earlier one: most of eight least hashes of their word triples differ."""
    form = words.evidence[0].astype(np.uint64)
    same = words.text[2:] == words.text[:-2] if len(form) > 2 else np.zeros(0, bool)
    triple = (form[:-2] * np.uint64(_BASE) + form[1:-1]) * np.uint64(_MIX) + form[2:] if len(form) > 2 else form[:0]
    triple, text = triple[same], words.text[2:][same] if len(form) > 2 else words.text[:0]
    kept, seen = np.ones(n_texts, bool), {}
    least = np.full((n_texts, 8), np.iinfo(np.uint64).max, np.uint64)
    for k in range(8):
        mixed = (triple ^ np.uint64(_MIX * (k + 1) % 2**64)) * np.uint64(_BASE)
        np.minimum.at(least[:, k], text, mixed ^ (mixed >> np.uint64(31)))
    for i in np.flatnonzero(np.bincount(text, minlength=n_texts)):
        met = [seen[k, v] for k, v in enumerate(least[i].tolist()) if (k, v) in seen]
        if met and max(map(met.count, met)) >= 4:
            kept[i] = False
        else:
            seen.update({(k, v): i for k, v in enumerate(least[i].tolist())})
    return kept


def tags_of(words: Words, toxic: np.ndarray, setting: Training = Training()) -> np.ndarray:
    """1 for the words of toxic texts with a form, beginning or ending that marks such texts."""
    counts = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for kind in words.evidence[:OWN]:
        some = kind >= 0
        pairs = np.unique(words.text[some].astype(np.int64) << BITS | kind[some])
        for k in (0, 1):
            counts[k] += np.bincount((pairs & ((1 << BITS) - 1))[toxic[pairs >> BITS] == k], minlength=1 << BITS)
    clean, bad = counts
    n_bad, n_clean = int(toxic.sum()), int(len(toxic) - toxic.sum())
    rest = lambda n, x: np.maximum(n - x, 0) + 0.5
    odds = np.log((bad + 0.5) / rest(n_bad, bad)) - np.log((clean + 0.5) / rest(n_clean, clean))
    error = np.sqrt(1 / (bad + 0.5) + 1 / rest(n_bad, bad) + 1 / (clean + 0.5) + 1 / rest(n_clean, clean))
    marks = np.append((odds >= setting.odds) & (odds >= setting.errors * error), False)
    return (marks[words.evidence[:OWN]].any(axis=0) & (toxic[words.text] == 1)).astype(np.int64)


# documents

def measures(marginals: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """What a document's score follows from: one, the highest marginal's log odds, the sum of marginals, their density."""
    highest, n = np.zeros(n_texts), np.bincount(text, minlength=n_texts)
    np.maximum.at(highest, text, marginals)
    total = np.bincount(text, marginals, n_texts)
    top = np.clip(highest, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(n_texts), np.log(top / (1 - top)), np.log1p(total), np.log1p(1000 * total / np.maximum(n, 1))], axis=1)


def curve(x: np.ndarray, wanted: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights for rows of measures, as if a share of them were toxic; Newton's method with a small ridge."""
    out = np.zeros(x.shape[1])
    n_bad = wanted.sum()
    if not 0 < n_bad < len(wanted):
        out[0] = np.log(share / (1 - share))
        return out
    weight = np.where(wanted == 1, share / n_bad, (1 - share) / (len(wanted) - n_bad)) * len(wanted)
    ridge = np.array([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        slope = x.T @ (weight * (p - wanted)) + ridge * out
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), slope)
        out -= np.clip(step, -2, 2)
    return out


@dataclass
class Model:
    field: Field
    curve: np.ndarray

    def score(self, measured: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measured @ self.curve, -30, 30)))


def learned_field(texts: list[str], toxic: np.ndarray, setting: Training = Training()) -> Field:
    """The field from whole documents' labels."""
    raw = [t.encode() for t in texts]
    cuts = np.cumsum([0, *map(len, raw)])
    words = words_of(np.frombuffer(b"".join(raw), np.uint8), cuts)
    kept = different(words, len(texts))
    number = np.cumsum(kept) - 1
    these = np.flatnonzero(kept[words.text])
    # whole texts go, so chains stay whole
    chain = np.cumsum(words.place[these] == 0) - 1
    left = Words(words.starts[these], words.ends[these], number[words.text[these]], chain, words.place[these], words.evidence[:, these])
    return field_of(left, tags_of(left, toxic[kept], setting), setting)


# Spark

def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, setting: Training = Training()) -> tuple[DataFrame, float]:
    """Different labelled texts (h, toxic, text), as many as the settings allow, and the share of toxic ones among all."""
    by_id = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    by_id = by_id.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    h = F.xxhash64("text", F.lit(setting.seed)).alias("h")
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", h)
    known = texts.distinct().join(by_id, "doc_id").groupBy("h").agg(F.avg("toxic").alias("toxic"))
    known = stored(known.select("h", (F.col("toxic") >= 0.5).cast("int").alias("toxic")))
    sizes = dict(known.groupBy("toxic").count().collect())  # two rows
    wanted = F.when(F.col("toxic") == 1, setting.toxic).otherwise(setting.other)
    draw = F.pmod(F.xxhash64("h", F.lit(setting.seed)), F.lit(2**30))
    room = F.when(F.col("toxic") == 1, F.lit(SPARE * setting.toxic / max(1, sizes.get(1, 0)))).otherwise(
        F.lit(SPARE * setting.other / max(1, sizes.get(0, 0))))
    order = Window.partitionBy("toxic").orderBy(draw, "h")
    chosen = known.where(draw < room * 2.0**30).withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    chosen = F.broadcast(chosen.select("h", "toxic"))  # bounded by the settings
    picked = docs.where(F.col("text").isNotNull()).select("text", h).join(chosen, "h")
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return picked.groupBy("h", "toxic").agg(F.first("text").alias("text")), share


def fit(docs: DataFrame, labels: DataFrame, setting: Training = Training()) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); None if nothing is labelled."""
    ship(docs.sparkSession)
    rows, share = sample(docs, labels, setting)
    rows = stored(rows)
    room = F.greatest(F.length("text") - setting.chars, F.lit(0)) + 1
    cut = F.col("text").substr(1 + F.pmod(F.xxhash64("h", F.lit(1)), room).cast("int"), F.lit(setting.chars))
    given = sorted(tuple(r) for r in rows.select("h", "toxic", cut.alias("text")).collect())
    if not given:
        return None
    field_ = learned_field([r[2] for r in given], np.array([r[1] for r in given], np.int64), setting)
    sent = docs.sparkSession.sparkContext.broadcast(field_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for data, cuts in text_pieces(batch.column(2)):
                words, n = words_of(data, cuts), len(cuts) - 1
                found = measures(sent.value.tag(words), words.text, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(list(found), pa.list_(pa.float64()))], names=["h", "toxic", "x"]
                )
                at += n

    whole = rows.select("h", "toxic", "text").mapInArrow(run, "h bigint, toxic int, x array<double>")
    measured = sorted(tuple(r) for r in whole.collect())  # a few numbers for each row of the sample
    x = np.array([r[2] for r in measured], np.float64).reshape(len(measured), -1)
    return Model(field_, curve(x if len(measured) else np.ones((0, 4)), np.array([r[1] for r in measured]), min(max(share, 1e-3), 1 - 1e-3)))


SPANS = "array<struct<start: int, end: int, marginal: double>>"


def spans_of(words: Words, marginals: np.ndarray, data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of toxic words, with the highest marginal of each; places count code points of the text."""
    at = np.flatnonzero(marginals >= 0.5)
    joined = (np.diff(at) == 1) & (words.chain[at[1:]] == words.chain[at[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(at) else at
    last = np.append(first[1:], len(at)) - 1 if len(at) else at
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = words.text[at[first]]
    begin = points[words.starts[at[first]]] - points[cuts[text]]
    end = points[words.ends[at[last]]] - points[cuts[text]]
    highest = np.maximum.reduceat(marginals[at], first) if len(at) else np.zeros(0)
    columns = [pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(highest)]
    structs = pa.StructArray.from_arrays(columns, names=["start", "end", "marginal"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(cuts) - 1))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), structs)


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score, predicted (1 from a score of one half) and spans."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score", "predicted", "spans")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = 0
            for data, cuts in text_pieces(batch.column(batch.schema.get_field_index("text"))):
                n = len(cuts) - 1
                words = words_of(data, cuts)
                marginals = model.field.tag(words) if model else np.zeros(len(words.starts))
                score = model.score(measures(marginals, words.text, n)) if model else np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, n).columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), spans_of(words, marginals, data, cuts)],
                    names=[*batch.schema.names, "score", "predicted", "spans"],
                )
                at += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int, spans {SPANS}")
