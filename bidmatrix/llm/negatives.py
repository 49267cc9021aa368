"""Hard-negative mining by angular triangle filtering.

Vectors become whole numbers, floor(scale * x), and a score is the integer inner product of two of them. For
every anchor the best other rows of its own label are its positives; for every positive the best rows of other
labels whose score lies in a window of per cents of the positive's score are its hard negatives.

Every row's angles to a few reference directions are stored. By the triangle inequality the angle of two rows
lies between the difference and the sum of their angles to any reference, so each reference gives an interval
for their cosine, and with the norms one for their score, widened by more than what rounding can do to it. Rows
are dealt out in chunks by nearest reference and angle, and a chunk keeps the range of its angles and norms: an
anchor meets only those chunks whose score interval overlaps its window, and inside a chunk only the stretch of
the sorted angles that can reach the window is scored, in integers.

Positives take two passes: an anchor's own chunk gives it scores to beat, then the chunks that may hold better
ones are met. All results are exact; the references, spherical means of a bounded sample (``sample`` rows),
only decide how much is skipped. A chunk meets at most ``part`` anchors in one group, and the number of chunks
is bounded, so the list of chunks that goes to every task is, too.

Cases: rows with a null vec_id, a null label, a null or empty vector, or any null or non-finite component take
no part. Labels are whole numbers. Vectors of different lengths have no score with each other. A vector of
zeros scores 0. Rows that repeat a vec_id are rows of their own, an anchor only leaves out itself. Equal scores
go by smaller vec_id. A score beyond 64 bits counts as the largest one. An empty table gives an empty result.
Other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import ship
from bidmatrix.session import stored


@dataclass(frozen=True)
class Mining:
    positives: int = 5  # of an anchor
    negatives: int = 5  # of a positive
    low: int = 80  # per cent of the positive's score
    high: int = 100
    scale: int = 256
    references: int = 16
    sample: int = 2048  # rows that the references are fitted to
    rows: int = 2048  # of a chunk, while that makes no more than `chunks`
    chunks: int = 4096
    part: int = 4096  # anchors that meet a chunk in one group
    seed: int = 13


LEAST, MOST = -(2**63), 2**63 - 1
#: Added to angles and, times the norms, to scores: far above the rounding of stored angles and of cosines.
SLACK = 1e-5
#: Anchors whose scores with a batch of rows are in memory together.
TOGETHER = 128


# angles and what follows from them

def directions(vectors: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Unit directions in the middle of the vectors' own: a few rounds of spherical means."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0, None]
    rng = np.random.default_rng([seed, vectors.shape[1]])
    drawn = rng.standard_normal((count, vectors.shape[1]))
    if len(units):
        picked = rng.choice(len(units), min(count, len(units)), replace=False)
        drawn[: len(picked)] = units[picked]
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    for _ in range(6):
        near = (units @ drawn.T).argmax(axis=1)
        sums = np.zeros_like(drawn)
        np.add.at(sums, near, units)
        size = np.linalg.norm(sums, axis=1)
        drawn[size > 0] = sums[size > 0] / size[size > 0, None]
    return drawn


def angles_to(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles between rows and references; a right angle for a vector of zeros, which scores 0 at any angle."""
    cosines = vectors @ references.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def cosine_bounds(own: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest cosine of vectors with anchors, over all references (last axis).

    ``own`` are the anchors' angles (A, 1, R), the vectors' lie from ``least`` to ``most`` (1, C, R).
    """
    near = np.maximum(0, np.maximum(own - most, least - own)).max(axis=2)
    low, high = own + least, own + most
    over = np.maximum(np.minimum(low, 2 * np.pi - low), np.minimum(high, 2 * np.pi - high))
    far = np.where((low <= np.pi) & (high >= np.pi), np.pi, over).min(axis=2)
    return np.cos(np.minimum(np.pi, far + SLACK)), np.cos(np.maximum(0, near - SLACK))


def score_bounds(cosines: tuple[np.ndarray, np.ndarray], norms: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Lowest and highest score for anchors of these norms (A, 1) and vectors of norms from least to most (1, C)."""
    low, high = cosines
    room = 2 + 1e-9 * norms * most
    return norms * low * np.where(low >= 0, least, most) - room, norms * high * np.where(high >= 0, most, least) + room


def stretch(angles: np.ndarray, own: np.ndarray, norms: np.ndarray, least: float, most: float, low: np.ndarray, high: np.ndarray):
    """From where to where in the ascending angles vectors can score from low to high with each anchor."""
    low, high = low.astype(float), high.astype(float)
    room = 2 + 1e-9 * norms * most + 1e-9 * np.abs(low)
    low, high = low - room, high + room

    def angle(score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """At which a score is reached; below 0 if at none, pi if at all."""
        size = norms * norm
        cosine = np.where(size > 0, score / np.where(size > 0, size, 1), np.where(score > 0, 2.0, -2.0))
        return np.where(cosine > 1, -1.0, np.arccos(np.clip(cosine, -1, 1)))

    widest = angle(low, np.where(low > 0, most, least))
    narrowest = np.maximum(0, angle(high, np.where(high > 0, least, most)) - SLACK)
    reach = widest + SLACK
    left = np.maximum(own - reach, narrowest - own) - SLACK
    right = np.minimum(own + reach, 2 * np.pi - narrowest - own) + SLACK
    start, stop = np.searchsorted(angles, left, "left"), np.searchsorted(angles, right, "right")
    stop = np.where(widest < 0, start, np.maximum(start, stop))
    return start, stop


def windows(scores: list[int], mining: Mining) -> tuple[list[int], list[int]]:
    """Lowest and highest whole score inside the window of each positive's score."""
    inside = lambda x: max(LEAST, min(MOST, x))
    return [inside(-(-mining.low * p // 100)) for p in scores], [inside(mining.high * p // 100) for p in scores]


# rows with their angles

CODED = "row bigint, vec_id bigint, label bigint, dim int, cell int, angle float, norm double, angles array<float>, vector binary"


def coded(rows: DataFrame, references: dict[int, np.ndarray], kind: str, mining: Mining) -> DataFrame:
    """CODED rows of (row, vec_id, label, embedding)."""
    sent = rows.sparkSession.sparkContext.broadcast(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(sent.value)
        for batch in batches:
            given = batch.column(3)
            lengths = given.value_lengths().to_numpy(zero_copy_only=False)
            flat = given.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                whole = np.floor(flat[starts[at][:, None] + np.arange(dim)].astype(np.float64) * mining.scale)
                if dim not in known:
                    known[dim] = directions(np.zeros((0, dim)), mining.references, mining.seed)
                norms = np.linalg.norm(whole, axis=1)
                angles = angles_to(whole, norms, known[dim]).astype(np.float32)
                cell = angles.argmin(axis=1)
                taken = [batch.column(k).take(pa.array(at)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken, pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)),
                        pa.array(angles[np.arange(len(at)), cell]), pa.array(norms), pa.array(list(angles), pa.list_(pa.float32())),
                        pa.array([v.tobytes() for v in whole.astype(kind)], pa.binary()),
                    ],
                    names=["row", "vec_id", "label", "dim", "cell", "angle", "norm", "angles", "vector"],
                )

    return rows.mapInArrow(run, CODED)


def directory(chunked: DataFrame, mining: Mining) -> dict[str, np.ndarray]:
    """Ranges of each chunk's norms and angles: as many rows as chunks."""
    angle = lambda k: F.col("angles")[k]
    ranges = [f(angle(k)).alias(f"{name}{k}") for name, f in (("a", F.min), ("b", F.max)) for k in range(mining.references)]
    kept = ("norm", "dim")
    found = chunked.groupBy("chunk").agg(
        *[F.min(c).alias(f"{c}0") for c in kept], *[F.max(c).alias(f"{c}1") for c in kept], *ranges
    ).orderBy("chunk").toPandas()
    of = lambda name: found[[f"{name}{k}" for k in range(mining.references)]].to_numpy(np.float64)
    out = {c: found[c].to_numpy() for c in ("chunk", "norm0", "norm1", "dim0", "dim1")}
    return out | {"least": of("a"), "most": of("b")}


# anchors meet chunks

ASKED = "row bigint, vec_id bigint, label bigint, dim int, norm double, angles array<float>, vector binary, home int, scores array<bigint>"
FOUND = "row bigint, slot int, score bigint, other bigint, other_id bigint"
_BOTH = ["chunk", "part", "kind", "row", "vec_id", "label", "dim", "cell", "angle", "norm", "angles", "vector", "lows", "highs"]


def routes(asked: DataFrame, chunks: dict[str, np.ndarray], same: bool, mining: Mining) -> DataFrame:
    """ASKED rows with the windows of their slots and the chunks that may reach one of them."""
    sent = asked.sparkSession.sparkContext.broadcast(chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            scores = col("scores").to_pylist()
            asked_for = [([s[0]], [MOST]) if same else windows(s, mining) for s in scores]
            angles = np.array(col("angles").to_pylist(), np.float64).reshape(len(scores), -1)
            norms, dims, home = (col(x).to_numpy() for x in ("norm", "dim", "home"))
            met = []
            for at in range(0, len(scores), 32):
                these = slice(at, at + 32)
                bounds = cosine_bounds(angles[these, None], c["least"][None], c["most"][None])
                low, high = score_bounds(bounds, norms[these, None], c["norm0"][None], c["norm1"][None])
                mixed = c["dim0"] != c["dim1"]  # angles of different lengths do not compare
                low, high = np.where(mixed, -np.inf, low), np.where(mixed, np.inf, high)
                fits = (c["dim0"] <= dims[these, None]) & (c["dim1"] >= dims[these, None])
                if same:  # its own chunk was met before
                    fits &= c["chunk"] != home[these, None]
                for k in range(len(fits)):
                    lows, highs = (np.array(x, np.float64)[:, None] for x in asked_for[at + k])
                    reach = ((lows <= highs) & (low[k] <= highs) & (high[k] >= lows)).any(axis=0)
                    met.append(c["chunk"][fits[k] & reach].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([a[i] for a in asked_for], pa.list_(pa.int64())) for i in (0, 1)], pa.array(met, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "lows", "highs", "met"],
            )

    return asked.mapInArrow(run, f"{ASKED}, lows array<bigint>, highs array<bigint>, met array<int>")


def products(one: np.ndarray, other: np.ndarray, safe: bool) -> np.ndarray:
    """Integer inner products. Sums below 2**53 are exact in doubles; others are taken in Python's integers."""
    if safe:
        return (one @ other.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in v] for v in m], dtype=object).reshape(m.shape)
    return np.clip(whole(one) @ whole(other).T, LEAST, MOST).astype(np.int64)


class Best:
    """The first k rows of every (anchor, slot), by falling score and rising id."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((5, 0), np.int64)  # entry, -score, id, row

    def floor(self, n: int) -> np.ndarray:
        """Score of the k-th row of each entry; the least number while there are fewer."""
        out = np.full(n, LEAST, np.int64)
        if self.rows.shape[1]:
            entry, score = self.rows[0], self.rows[1]
            last = np.flatnonzero(self.rows[4] == self.k - 1)
            out[entry[last]] = score[last]
        return out

    def add(self, entry: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(entry):
            return
        new = np.stack([entry, score, ids, row, np.zeros(len(entry), np.int64)])
        rows = np.concatenate([self.rows, new], axis=1)
        # ~x falls as x rises, and unlike -x it never overflows
        rows = rows[:, np.lexsort((rows[3], rows[2], ~rows[1], rows[0]))]
        starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        rows[4] = np.arange(rows.shape[1]) - np.repeat(starts, sizes)
        self.rows = rows[:, rows[4] < self.k]


class Group:
    """The anchors of one group, and the best rows that they have met."""

    def __init__(self, anchors: pa.Table, kind: str, same: bool, k: int):
        col = lambda name: anchors.column(name)
        self.row, self.label, self.norm, self.dim = (col(x).to_numpy() for x in ("row", "label", "norm", "dim"))
        self.angles = np.array(col("angles").to_pylist(), np.float64).reshape(len(self.row), -1)
        self.vectors = [np.frombuffer(v, kind).astype(np.float64) for v in col("vector").to_pylist()]
        lows, highs = (col(x).to_pylist() for x in ("lows", "highs"))
        self.slots = max(map(len, lows))
        fill = lambda rows, value: np.array([r + [value] * (self.slots - len(r)) for r in rows], np.int64)
        self.low, self.high = fill(lows, MOST), fill(highs, LEAST)  # a slot that is not asked for has an empty window
        self.kind, self.same, self.best = kind, same, Best(k)

    def meet(self, rows: pa.Table) -> None:
        dim, cell = rows.column("dim").to_numpy(), rows.column("cell").to_numpy()
        runs = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1])]))
        angle, norm, label, row, ids = (rows.column(x).to_numpy() for x in ("angle", "norm", "label", "row", "vec_id"))
        vectors = rows.column("vector").combine_chunks()
        for start, stop in zip(runs, [*runs[1:], len(dim)]):
            anchors = np.flatnonzero(self.dim == dim[start])
            if not len(anchors):
                continue
            least, most = norm[start:stop].min(), norm[start:stop].max()
            lowest = np.where(self.low[anchors] <= self.high[anchors], self.low[anchors], MOST).min(axis=1)
            highest = np.where(self.low[anchors] <= self.high[anchors], self.high[anchors], LEAST).max(axis=1)
            own = self.angles[anchors, cell[start]]
            left, right = stretch(angle[start:stop].astype(np.float64), own, self.norm[anchors], least, most, lowest, highest)
            reached = np.flatnonzero((left < right) & (lowest <= highest))
            # anchors of like stretches go together, so that what they share is little more than what each needs
            reached = reached[np.argsort(left[reached], kind="stable")]
            for at in range(0, len(reached), TOGETHER):
                some = reached[at : at + TOGETHER]
                a, b = start + left[some].min(), start + right[some].max()
                raw = b"".join(vectors.slice(a, b - a).to_pylist())
                met = np.frombuffer(raw, self.kind).astype(np.float64).reshape(b - a, int(dim[start]))
                self._score(anchors[some], met, label[a:b], row[a:b], ids[a:b], float(most))

    def _score(self, who: np.ndarray, met: np.ndarray, label: np.ndarray, row: np.ndarray, ids: np.ndarray, most: float) -> None:
        scores = products(np.array([self.vectors[i] for i in who]), met, self.norm[who].max() * max(most, 1) < 2.0**53)
        fits = (self.label[who][:, None] == label) == self.same
        if self.same:
            fits &= self.row[who][:, None] != row
        floor = self.best.floor(len(self.row) * self.slots).reshape(-1, self.slots)[who]
        for slot in range(self.slots):
            low, high = np.maximum(self.low[who, slot], floor[:, slot]), self.high[who, slot]
            inside = fits & (scores >= low[:, None]) & (scores <= high[:, None])
            crowded = np.flatnonzero(inside.sum(axis=1) > 4 * self.best.k)
            if len(crowded):  # only scores up to the k-th best matter
                kept = np.where(inside[crowded], scores[crowded], LEAST)
                kth = np.partition(kept, kept.shape[1] - self.best.k, axis=1)[:, kept.shape[1] - self.best.k]
                inside[crowded] &= scores[crowded] >= kth[:, None]
            i, j = np.nonzero(inside)
            self.best.add(who[i] * self.slots + slot, scores[i, j], ids[j], row[j])

    def found(self) -> pa.RecordBatch:
        entry, score, ids, row = self.best.rows[:4]
        columns = [self.row[entry // self.slots], (entry % self.slots).astype(np.int32), score, row, ids]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "slot", "score", "other", "other_id"])


def meetings(routed: DataFrame, chunked: DataFrame, kind: str, same: bool, mining: Mining) -> DataFrame:
    """FOUND rows: per chunk the best ones of each anchor's slots, over the rows whose score may fit."""
    k = mining.positives if same else mining.negatives
    sent = routed.withColumn("chunk", F.explode("met"))
    crowd = stored(sent.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / mining.part).cast("int").alias("parts")))
    few = F.broadcast(crowd)  # at most as many rows as chunks
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    left = sent.join(few, "chunk").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).select(
        "chunk", "part", F.lit(0).alias("kind"), "row", "vec_id", "label", "dim", nothing("cell", "int"), nothing("angle", "float"),
        "norm", "angles", "vector", "lows", "highs",
    )
    right = chunked.join(few, "chunk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "chunk", "part", F.lit(1).alias("kind"), "row", "vec_id", "label", "dim", "cell", "angle", "norm",
        nothing("angles", "array<float>"), "vector", nothing("lows", "array<bigint>"), nothing("highs", "array<bigint>"),
    )
    both = left.unionByName(right).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind", "dim", "cell", "angle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, group = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            marks = [table.column(c).to_numpy() for c in ("chunk", "part", "kind")]
            edges = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist(), table.num_rows]
            for start, stop in zip(edges[:-1], edges[1:]):
                piece, now = table.slice(start, stop - start), (marks[0][start], marks[1][start])
                if now != key:
                    if group is not None:
                        yield group.found()
                    key, anchors, group = now, [], None
                if marks[2][start] == 0:
                    anchors.append(piece)
                elif anchors:  # by chance a part may have got none
                    group = group or Group(pa.concat_tables(anchors), kind, same, k)
                    group.meet(piece)
        if group is not None:
            yield group.found()

    return both.select(*_BOTH).mapInArrow(run, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor's slot, with their rank from 1."""
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, embedding).

    ``anchor`` tells by a row's vec_id whether it is one.
    """
    ship(rows.sparkSession)
    spark = rows.sparkSession
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    given = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    usable = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite)
    usable = usable.select(F.monotonically_increasing_id().alias("row"), "*")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    n, top = usable.agg(F.count(F.lit(1)), F.max(largest)).first()
    top = (top or 0) * mining.scale + 1
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"

    drawn: dict[int, list] = {}
    for r in usable.orderBy(F.xxhash64("vec_id", F.lit(mining.seed))).limit(mining.sample).select("embedding").collect():
        drawn.setdefault(len(r[0]), []).append(r[0])
    references = {d: directions(np.floor(np.array(v) * mining.scale), mining.references, mining.seed) for d, v in drawn.items()}

    n_chunks = min(mining.chunks, max(64, n // mining.rows))
    dealt = coded(usable, references, kind, mining).repartitionByRange(n_chunks, "dim", "cell", "angle", "vec_id", "row")
    chunked = stored(dealt.withColumn("chunk", F.spark_partition_id()))
    chunks = directory(chunked, mining)

    asked = ["row", "vec_id", "label", "dim", "norm", "angles", "vector", F.col("chunk").alias("home")]
    anchors = chunked.where(anchor).select(*asked)
    nothing_yet = F.array(F.lit(LEAST).cast("bigint"))
    windowed = lambda df, lows, highs, met: df.withColumn("lows", lows).withColumn("highs", highs).withColumn("met", met)
    at_home = windowed(anchors, nothing_yet, F.array(F.lit(MOST).cast("bigint")), F.array("home"))
    near = stored(meetings(at_home, chunked, kind, True, mining))

    beat = near.groupBy("row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    beat = beat.select("row", F.when(F.col("n") == mining.positives, F.col("least")).alias("least"))
    seeking = anchors.join(beat, "row", "left").withColumn("scores", F.array(F.coalesce("least", F.lit(LEAST).cast("bigint")))).drop("least")
    routed = stored(routes(seeking, chunks, True, mining))
    positives = stored(first(near.unionByName(meetings(routed, chunked, kind, True, mining)), mining.positives))

    slots = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("all"))  # a few per anchor
    seeking = anchors.join(slots, "row").withColumn("scores", F.col("all.score")).drop("all")
    routed = stored(routes(seeking, chunks, False, mining))
    negatives = first(meetings(routed, chunked, kind, False, mining), mining.negatives)
    matched = negatives.join(
        positives.select("row", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["row", "slot"],
    ).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return matched.select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
