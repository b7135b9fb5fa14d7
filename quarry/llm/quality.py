"""Quality of texts by a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one for each feature's bins, and one for each of a few pairs of features. Cyclic boosting
learns them: in turn, each feature's (then each pair's) table gains a small step towards a shallow tree fitted to the gradient of
the logistic loss. Scoring adds one entry of each table, by vectorised indexing, and takes the logistic function.

Features are counts of kinds of bytes and of words, made from whole texts. They are written once, slim, so that no text is ever
shuffled. The model learns from a bounded sample of the labelled ids (`max_rows`, those with the least hashes); they are the only
rows that reach the driver. It is a few thousand numbers, whatever the input's size.

Defined results: null text counts as empty and gets a score; null labels teach nothing, repeated labels of an id count as the
lowest of them; with no labels at all every score is 0.5; repeated rows get a row each; an empty table gives an empty result; the
input's columns are carried inside one struct, so that clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import as_bytes, crc_remainder, saved, small_batches, turned_to, whole

#: Labelled rows that the model learns from, at most.
MAX_ROWS = 40_000
KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "shout", "bar", "noise", "mark", "high", "control")
FEATURES = ("length", *KINDS, "word_length", "repeats", "distinct", "noisy_ends", "line_length", "capitals")
TOGETHER = 1 << 20


def _kinds() -> np.ndarray:
    of = np.full(256, KINDS.index("mark"), np.uint8)
    for name, chars in (("digit", b"0123456789"), ("space", b" \t\x0b\x0c\r"), ("newline", b"\n"), ("stop", b".?"), ("comma", b",;:"), ("shout", b"!"), ("bar", b"|"), ("noise", b"#$%&*")):
        of[list(chars)] = KINDS.index(name)
    of[65:91], of[97:123], of[128:] = KINDS.index("upper"), KINDS.index("lower"), KINDS.index("high")
    of[[*range(9), *range(14, 32), 127]] = KINDS.index("control")
    return of


_KIND = _kinds()
_POWERS = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _features(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(n), sizes + 1)
    kind = _KIND[data]
    counts = np.bincount(owner * 16 + kind, minlength=16 * n).reshape(n, 16)[:, : len(KINDS)].astype(float)
    counts[:, KINDS.index("newline")] -= 1  # the separator
    blank = (kind == KINDS.index("space")) | (kind == KINDS.index("newline"))
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    out = np.zeros((n, len(FEATURES)))
    total = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 1 : 1 + len(KINDS)] = counts / total[:, None]
    words = np.zeros(n)
    if len(starts):
        ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
        of = owner[starts]
        words = np.bincount(of, minlength=n).astype(float)
        place = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)])) if starts[0] == 0 else None
        if place is None:
            place = np.r_[np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))]
        hashes = np.add.reduceat(np.where(blank, 0, data).astype(np.uint64) * _POWERS[place & 63], starts)
        same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        distinct = np.unique((of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))) >> np.uint64(40)
        last = kind[ends - 1]
        at = 1 + len(KINDS)
        each = np.maximum(words, 1)
        out[:, at] = np.bincount(of, ends - starts, minlength=n) / each
        out[:, at + 1] = np.bincount(of[1:][same], minlength=n) / each
        out[:, at + 2] = np.bincount(distinct.astype(np.int64), minlength=n) / each
        out[:, at + 3] = np.bincount(of[(last == KINDS.index("noise")) | (last == KINDS.index("shout"))], minlength=n) / each
        out[:, at + 5] = np.bincount(of[kind[starts] == KINDS.index("upper")], minlength=n) / each
    out[:, 1 + len(KINDS) + 4] = np.log1p(sizes / (counts[:, KINDS.index("newline")] + 1))
    return out


def text_features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each UTF-8 text."""
    out, part, size = [np.zeros((0, len(FEATURES)))], [], 0
    for t in texts:
        if part and size + len(t) > TOGETHER:
            out.append(_features(part))
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        out.append(_features(part))
    return np.concatenate(out)


@dataclass
class AdditiveModel:
    """base plus tables[f][bin of f] over all features plus grids[p][bin of a, bin of b] over the pairs."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    coarse: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        total = np.full(len(x), self.base)
        for own, t in zip(bins, self.tables):
            total += t[own]
        for (a, b), g in zip(self.pairs, self.grids):
            total += g[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-total))


def _step(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins, grown leaf by leaf: each bin's value. g, h: sums of gradient and curvature of the bins."""
    parts, value = [(0, len(g))], np.zeros(len(g))
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (ht - hl < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (i, a + k + 1))
        if best[1] is None:
            break
        i, cut = best[1]
        a, b = parts[i]
        parts[i : i + 1] = [(a, cut), (cut, b)]
    for a, b in parts:
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return value


def _grid_step(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """A tree of two levels over a grid: one cut of the first axis, one of the second on each side. Its gain, and the values."""
    best, value = 0.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        own, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, len(g))):
            gl, hl = np.cumsum(g[rows].sum(0)), np.cumsum(h[rows].sum(0))
            gt, ht = gl[-1], hl[-1]
            side = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
            side[(hl < least) | (ht - hl < least)] = gt**2 / (ht + 1)
            k = int(side.argmax())
            gain += side[k]
            own[rows, : k + 1] = gl[k] / (hl[k] + 1)
            own[rows, k + 1 :] = (gt - gl[k]) / (ht - hl[k] + 1)
        if gain > best:
            best, value = gain, own
    return best - float(g.sum() ** 2 / (h.sum() + 1)), value


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, cells: int = 8, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1) -> AdditiveModel:
    """x: rows of features, y: 0 or 1. The same rows in any order give the same model up to rounding."""
    n = len(y)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) if n else np.zeros(0) for c in x.T]
    own = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.minimum(np.arange(len(t)) * cells // len(t), cells - 1) for t in tables]
    total, least = np.full(n, base), max(1.0, 0.0005 * n)
    if n and 0 < y.sum() < n:
        for _ in range(rounds):
            for f, t in enumerate(tables):
                p = 1 / (1 + np.exp(-total))
                step = rate * _step(np.bincount(own[f], y - p, len(t)), np.bincount(own[f], p * (1 - p), len(t)), 3, least)
                t += step
                total += step[own[f]]
    grids, pairs, cell = [], [], {}
    if n and 0 < y.sum() < n:
        p = 1 / (1 + np.exp(-total))
        gains = []
        for a, b in combinations(range(len(tables)), 2):
            at = coarse[a][own[a]] * cells + coarse[b][own[b]]
            sums = [np.bincount(at, w, cells * cells).reshape(cells, cells) for w in (y - p, p * (1 - p))]
            gains.append((-_grid_step(*sums, least)[0], a, b))
            cell[a, b] = at
        pairs = [(a, b) for _, a, b in sorted(gains)[:n_pairs]]
        grids = [np.zeros((cells, cells)) for _ in pairs]
        for _ in range(pair_rounds):
            for pair, grid in zip(pairs, grids):
                p = 1 / (1 + np.exp(-total))
                sums = [np.bincount(cell[pair], w, cells * cells).reshape(cells, cells) for w in (y - p, p * (1 - p))]
                step = rate * _grid_step(*sums, least)[1]
                grid += step
                total += step.ravel()[cell[pair]]
    return AdditiveModel(base, edges, tables, pairs, grids, coarse)


def quality_scores(
    df: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    held_out: tuple[int, int] = (4, 2), max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Columns row (a struct of the columns `carry`), held_out, score. labels: columns id_col and label_col. Ids whose crc32 as
    text leaves the remainder held_out[1] modulo held_out[0] teach nothing."""
    out = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])
    rows = df.select(F.struct(*carry).alias("row"), F.col(id_col).alias("id"), whole(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["id"], *out])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned_to("quality")
        for batch in batches:
            found = text_features(as_bytes(batch.column("text")))
            ends = pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=["row", "id", "features"])

    with small_batches(df.sparkSession):
        made = saved(rows.mapInArrow(extract, schema), "features")
    teach = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.min(label_col).alias("label"))
    teach = teach.where(crc_remainder("of", held_out[0]) != held_out[1])
    # one row of each labelled id, repeated ids with their least features; of more than max_rows, those with the least hashes
    labelled = made.join(teach, F.col("id") == F.col("of")).groupBy("id").agg(F.min("features").alias("features"), F.min("label").alias("label"))
    drawn = labelled.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    taught = drawn.toPandas().sort_values("id", kind="stable")
    x = np.array(taught["features"].tolist(), float).reshape(-1, len(FEATURES))
    model = fit(x, (taught["label"].to_numpy(float) > 0.5).astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array(model.score(x))], names=["row", "held_out", "score"])

    scored = T.StructType([rows.schema["row"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return made.select("row", (crc_remainder("id", held_out[0]) == held_out[1]).alias("held_out"), "features").mapInArrow(score, scored)
