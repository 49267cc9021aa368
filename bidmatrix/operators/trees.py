"""Texts within an edit distance of many labels at once: a walk over the tree of the texts' beginnings.

Texts that begin alike share the work on what they share, and a beginning that is further from every beginning of a
label than the distance allows ends the walk, with all texts below it. A level of the tree is walked for many labels by
a few array operations; what is held at a time is bounded by STEP, whatever the numbers of texts and labels.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# workers may not have the package: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a walk that are worked on at once, about, and labels that set out together.
STEP, SETTING_OUT = 1 << 19, 1 << 12
#: Places of a label beyond its end: no character.
BEYOND = 0xFFFFFFFF


def characters(texts: list[str], width: int, fill: int) -> np.ndarray:
    """A row of code points per text, filled up to ``width``."""
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Tree:
    """The beginnings of sorted different texts, level by level: a node's character, its children, the text that ends in it
    and the least and greatest length of the texts below."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.depth = int(sizes.max())
        rows = characters(texts, self.depth + 1, 0)
        shared = np.full(len(texts), -1, dtype=np.int64)  # characters shared with the text before
        shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
        self.chars, self.first, self.count, self.ends, self.least, self.most = [], [], [], [], [], []
        above = None
        for d in range(self.depth + 1):
            starts = np.flatnonzero((shared < d) & (sizes >= d))
            self.chars.append(rows[starts, d - 1] if d else None)
            self.ends.append(np.where(sizes[starts] == d, starts, -1))
            self.least.append(np.minimum.reduceat(sizes, starts))  # lengths of the texts below; a shorter text between two nodes may count
            self.most.append(np.maximum.reduceat(sizes, starts))
            if above is not None:
                parent = np.searchsorted(above, starts, side="right") - 1
                self.count.append(np.bincount(parent, minlength=len(above)))
                self.first.append(np.cumsum(self.count[-1]) - self.count[-1])
            above = starts
        self.count.append(np.zeros(len(above), dtype=np.int64))
        self.first.append(np.zeros(len(above), dtype=np.int64))

    def walk(self, labels: np.ndarray, sizes: np.ndarray, asked: np.ndarray, radius: int, bound: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(label, text, distance) of texts no further than ``bound`` from the ``asked`` labels; lowers the bounds to what it finds.

        A row holds the distances of a beginning from the label's beginnings that are at most ``radius`` longer or shorter. What
        is left of the label and of the texts below differs in length by something, which has to be added in any case.
        """
        width, far, flat, columns = 2 * radius + 1, radius + 1, labels.ravel(), labels.shape[1]
        place = np.arange(-radius, radius + 1)[:, None]
        begin = np.where((place >= 0) & (place <= sizes[asked][None, :]), place, far).astype(np.uint8)
        found = [self._ended(0, asked, np.zeros(len(asked), dtype=np.int64), begin, sizes, radius, bound)]
        todo = [(0, asked, np.zeros(len(asked), dtype=np.int64), begin, np.zeros(len(asked), dtype=np.int16))]
        while todo:
            d, label, node, row, least = todo.pop()
            alive = least <= bound[label]
            if not alive.all():
                label, node, row, least = label[alive], node[alive], row[:, alive], least[alive]
            n = self.count[d][node]
            total = int(n.sum())
            if total > STEP and len(label) > 1:
                half = len(label) // 2
                todo += [(d, *(x[..., half:] for x in (label, node, row, least))), (d, *(x[..., :half] for x in (label, node, row, least)))]
                continue
            if not total:
                continue
            of = np.repeat(np.arange(len(label)), n)
            child = self.first[d][node][of] + np.arange(total) - (np.cumsum(n) - n)[of]
            label, old, char = label[of], row[:, of], self.chars[d + 1][child]
            new, base, size = np.empty_like(old), label * columns, sizes[label]
            longer = np.clip(size - self.most[d + 1][child] + radius, -200, 200).astype(np.int16)
            shorter = np.clip(self.least[d + 1][child] - size - radius, -200, 200).astype(np.int16)
            least = np.full(total, far, dtype=np.int16)
            for k in range(width):
                j = d + 1 - radius + k
                if j < 0:
                    new[k] = far
                    continue
                value = old[k + 1] + 1 if k + 1 < width else np.full(total, far, dtype=np.uint8)
                if j:
                    np.minimum(value, old[k] + (flat[base + (j - 1)] != char), out=value)
                    if k:
                        np.minimum(value, new[k - 1] + 1, out=value)
                value[size < j] = far
                np.minimum(value, far, out=new[k])
                np.minimum(least, new[k] + np.maximum(np.maximum(longer - k, shorter + k), 0), out=least)
            kept = np.flatnonzero(least <= bound[label])
            label, child, new, least = label[kept], child[kept], new[:, kept], least[kept]
            found.append(self._ended(d + 1, label, child, new, sizes, radius, bound))
            todo.append((d + 1, label, child, new, least))
        return found

    def _ended(self, d, label, node, row, sizes, radius, bound):
        """What of the rows ends in a text near enough."""
        at = sizes[label] - d + radius
        here = np.flatnonzero((self.ends[d][node] >= 0) & (at >= 0) & (at <= 2 * radius))
        label, distance, text = label[here], row[at[here], here].astype(np.int64), self.ends[d][node[here]]
        near = distance <= bound[label]
        np.minimum.at(bound, label[near], distance[near])
        return label[near], text[near], distance[near]


def nearest(labels: list[str], texts: list[str], radius: int) -> tuple[list[str], list[str]]:
    """Pairs of a label and each of its closest texts, for labels that have a text within ``radius``.

    Texts of like length make up a tree, so that one long text does not widen all rows.
    """
    labels, texts = sorted(set(labels)), sorted(set(texts))
    sizes = np.fromiter(map(len, labels), dtype=np.int64, count=len(labels))
    bound = np.full(len(labels), radius, dtype=np.int64)
    grades: dict[int, list[str]] = {}
    for text in texts:
        grades.setdefault((len(text) >> 5).bit_length(), []).append(text)
    found = []
    for grade, members in grades.items():
        least, most = min(map(len, members)), max(map(len, members))
        near = np.flatnonzero((sizes >= least - radius) & (sizes <= most + radius))
        if not len(near):
            continue
        tree = Tree(members)
        for start in range(0, len(near), SETTING_OUT):
            part = near[start : start + SETTING_OUT]
            chars = characters([labels[i] for i in part], most + radius + 1, BEYOND)
            own = bound[part]
            for label, text, distance in tree.walk(chars, sizes[part], np.arange(len(part)), radius, own):
                found += zip(part[label].tolist(), [members[t] for t in text.tolist()], distance.tolist())
            bound[part] = own
    pairs = [(labels[i], text) for i, text, distance in found if distance == bound[i]]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def meet(radius: int):
    """The closest texts of a group's labels among its entries, as a function of two Arrow tables."""
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not (asked.num_rows and held.num_rows):
            return pa.table({"of": [], "text": [], "entry": []}, schema=PAIRS)
        label, text = nearest(asked.column("text").to_pylist(), held.column("entry").to_pylist(), radius)
        return pa.table({"of": [asked.column("of")[0].as_py()] * len(label), "text": label, "entry": text}, schema=PAIRS)

    return run


PAIRS = pa.schema([("of", pa.string()), ("text", pa.string()), ("entry", pa.string())])
