"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labelled tokens.  Labels are per document, so tokens are labelled from a
sample: a token of a toxic document is toxic if its word or a prefix of it is
found in many more toxic than other documents of the sample; all other tokens
are not.  The sample is the first ``per_class`` labelled documents of either
class in order of a hash of their id, a documented bound; it is the only thing
that comes to the driver.

Model.  Two labels; features of a token are its word, prefixes and suffixes,
hashed into a table of fixed size, so the model is a broadcast of 1 MB.  The
field is fitted by gradient steps on its likelihood (forward-backward over
padded windows).  A logistic layer turns a document's marginals (their largest,
their sum, their share) into its score; it is fitted on marginals that a field
fitted on the other half of the sample gave.

Scoring runs forward-backward over every token of every whole text, many texts
abreast, as ratios of the two labels.  No label, language, source or id is an
input of a score.

Defined cases: null text counts as empty and scores like one; a corpus without
labelled rows of both classes gives score 0 everywhere; equal texts score
alike; labels given twice count once, toxic if any row says so; an empty table
gives an empty result; columns pass through, except that result columns
replace those of their name.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+")
SIZE = 1 << 18
COUNTERS = 1 << 24
MEMO = 500_000


@dataclass(frozen=True)
class Settings:
    per_class: int = 3000
    min_docs: int = 3
    log_odds: float = 3.0
    around: int = 8
    steps: int = 45
    windows: int = 40  # of a labelled document, from its first suspect tokens: bounds what is fitted on, not what is scored


@dataclass
class Field:
    """Weights of the features for the toxic label (against the other), and log transitions [from][to]."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    layer: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0, 0, 0, 0]))


def names(word: str) -> list[str]:
    n = len(word)
    return ["=" + word] + ["<" + word[:k] for k in (3, 4, 5, 6, 7, 8) if k < n] + [">" + word[-k:] for k in (3, 4) if k < n]


def slots(word: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SIZE for x in names(word)]


def _ratios(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to other) and marginals of padded rows e[text, token]."""
    with np.errstate(over="ignore"):
        a = np.exp(moves)
        x = np.exp(np.clip(e, -30, 30))
    n, t = e.shape
    fwd, bwd = np.empty_like(x), np.ones_like(x)
    fwd[:, 0] = r = x[:, 0] * math.exp(start)
    for i in range(1, t):
        r = x[:, i] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
        fwd[:, i] = r
    b = np.ones(n)
    for i in range(t - 2, -1, -1):
        y = x[:, i + 1] * b
        b = np.where(mask[:, i + 1], (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y), 1.0)
        bwd[:, i] = b
    odds = fwd * bwd
    return fwd, bwd, np.where(mask, odds / (1 + odds), 0.0)


def fit_field(rows: list[list[str]], labels: list[list[int]], steps: int) -> Field:
    """The field that fits rows of words with 0/1 labels; rows are short windows."""
    n, t = len(rows), max(map(len, rows))
    mask = np.zeros((n, t), bool)
    y = np.zeros((n, t))
    cache: dict[str, list[int]] = {}
    cell, slot = [], []
    for i, (r, lab) in enumerate(zip(rows, labels, strict=True)):
        mask[i, : len(r)] = True
        y[i, : len(r)] = lab
        for j, w in enumerate(r):
            f = cache.get(w)
            if f is None:
                f = cache[w] = slots(w)
            slot += f
            cell += [i * t + j] * len(f)
    cell, slot = np.array(cell), np.array(slot)
    w, moves, start = np.zeros(SIZE), np.zeros((2, 2)), 0.0
    gw, gm, gs = np.full(SIZE, 1e-6), np.full((2, 2), 1e-6), 1e-6
    pair = mask[:, 1:]
    seen = np.zeros((2, 2))
    for p in (0, 1):
        for q in (0, 1):
            seen[p, q] = (pair & (y[:, :-1] == p) & (y[:, 1:] == q)).sum()
    for _ in range(steps):
        e = np.bincount(cell, w[slot], n * t).reshape(n, t)
        fwd, bwd, p = _ratios(e, mask, moves, start)
        d = ((y - p) * mask).ravel()
        g = np.bincount(slot, d[cell], SIZE) - 1e-3 * w
        # Expected moves: forward at i, move, emission and backward at i + 1, normalised over the four.
        a, x = np.exp(moves), np.exp(np.clip(e, -30, 30))
        f0, y1 = 1 / (1 + fwd[:, :-1]), x[:, 1:] * bwd[:, 1:]
        f1 = 1 - f0
        four = np.stack([f0 * a[0, 0], f0 * a[0, 1] * y1, f1 * a[1, 0], f1 * a[1, 1] * y1])
        four = np.where(pair, four / four.sum(0), 0).sum((1, 2)).reshape(2, 2)
        m, s = seen - four - 1e-2 * moves, float((y[:, 0] - p[:, 0]).sum())
        gw, gm, gs = gw + g * g, gm + m * m, gs + s * s
        w = w + 0.5 * g / np.sqrt(gw)
        moves = moves + 0.2 * m / np.sqrt(gm)
        start += 0.2 * s / math.sqrt(gs)
    return Field(w.astype(np.float32), moves, start)


class Scorer:
    """Marginals of texts under a field; words are scored once and kept in a bounded memo."""

    def __init__(self, model: Field) -> None:
        self.model, self.memo = model, {}

    def emissions(self, words: list[str]) -> np.ndarray:
        memo, w = self.memo, self.model.weights
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for x in words:
            v = memo.get(x)
            if v is None:
                v = memo[x] = float(w[slots(x)].sum())
            out.append(v)
        return np.array(out)

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        rows = [self.emissions(TOKEN.findall(t.lower())) for t in texts]
        out: list[np.ndarray] = [np.empty(0)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            upto = at + 1
            first = len(rows[order[at]])
            while upto < len(order) and len(rows[order[upto]]) <= 1.3 * first + 16 and (upto - at + 1) * len(rows[order[upto]]) <= 1 << 20:
                upto += 1
            group = order[at:upto]
            t = len(rows[group[-1]])
            e, mask = np.zeros((len(group), t)), np.zeros((len(group), t), bool)
            for k, i in enumerate(group):
                e[k, : len(rows[i])] = rows[i]
                mask[k, : len(rows[i])] = True
            p = _ratios(e, mask, self.model.moves, self.model.start)[2]
            for k, i in enumerate(group):
                out[i] = p[k, : len(rows[i])]
            at = upto
        return out


def summary(p: np.ndarray) -> list[float]:
    """What the logistic layer sees of a document."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    s = float(p[p > 0.1].sum())  # so that the small marginals of a very long clean text don't add up
    return [1.0, float(p.max()), math.log1p(s), math.log1p(200 * s / (len(p) + 20)), math.log1p(len(p)) / 10]


def _fit_layer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _cells(word: str) -> list[int]:
    """Where the word and its longer prefixes are counted."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % COUNTERS for x in names(word) if x[0] == "=" or x[0] == "<" and len(x) > 4]


def _windows(texts: list[str], toxic: list[int], settings: Settings) -> tuple[list[list[str]], list[list[int]]]:
    """Windows around the tokens that look toxic, labelled, and one more of each text.

    Documents per feature are counted in two tables of fixed size, so memory doesn't grow with the vocabulary.
    """
    counts = np.zeros((2, COUNTERS), np.uint16)
    words = [TOKEN.findall(t.lower()) for t in texts]
    for ws, y in zip(words, toxic, strict=True):
        cells = np.unique(np.fromiter((c for w in set(ws) for c in _cells(w)), np.int64))
        counts[int(y)][cells] += 1
    n1, n0 = sum(toxic) + 1, len(toxic) - sum(toxic) + 1
    bad, good = counts[1].astype(np.float32), counts[0].astype(np.float32)
    lexicon = (bad >= settings.min_docs) & (np.log((bad + 0.5) / n1) - np.log((good + 0.5) / n0) > settings.log_odds)
    suspect = {w for ws in words for w in set(ws) if any(lexicon[c] for c in _cells(w))}
    rows, labels, a = [], [], settings.around
    for ws, y in zip(words, toxic, strict=True):
        hits = [i for i, w in enumerate(ws) if w in suspect]
        marked = set(hits) if y else set()
        middle = zlib.crc32(" ".join(ws[:3]).encode("utf-8", "surrogatepass")) % max(len(ws), 1)
        last = -1
        for i in sorted({*hits[: settings.windows], middle}) if ws else []:
            if i <= last:
                continue
            lo, hi = max(i - a, last + 1), min(i + 2 * a, len(ws))
            rows.append(ws[lo:hi])
            labels.append([int(k in marked) for k in range(lo, hi)])
            last = hi - 1
    return rows, labels


def fit(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Field | None:
    """The model; None unless both classes occur."""
    if not 0 < sum(toxic) < len(toxic):
        return None
    half = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t in texts]
    xs, ys = [], []
    for h in (0, 1):
        train = [i for i in range(len(texts)) if half[i] != h]
        other = [i for i in range(len(texts)) if half[i] == h]
        if not other or not 0 < sum(toxic[i] for i in train) < len(train):
            continue
        part = fit_field(*_windows([texts[i] for i in train], [toxic[i] for i in train], settings), settings.steps)
        xs += [summary(p) for p in Scorer(part).marginals([texts[i] for i in other])]
        ys += [toxic[i] for i in other]
    model = fit_field(*_windows(texts, toxic, settings), settings.steps)
    if not 0 < sum(ys) < len(ys):
        xs, ys = [summary(p) for p in Scorer(model).marginals(texts)], toxic
    model.layer = _fit_layer(np.array(xs), np.array(ys, float))
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Field | None:
    """Fits on labels(doc_id, toxic) for which ``usable`` holds, joined with docs(doc_id, text)."""
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y: known.where((F.col("toxic") > 0) == F.lit(y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class)
    chosen = pick(True).unionByName(pick(False))  # at most 2 * per_class rows, so it may be broadcast
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toPandas()
    return fit([t or "" for t in sample["text"]], [int(t > 0) for t in sample["toxic"]], settings)


def score(docs: DataFrame, model: Field | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with score (double, 0 to 1) and toxic_spans (start, end in code points, p) of tokens with marginals of ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    @F.pandas_udf("score double, toxic_spans array<struct<start:int,end:int,p:double>>")
    def run(column: pd.Series) -> pd.DataFrame:
        if "scorer" not in held:
            held["scorer"] = Scorer(sent.value) if sent.value is not None else None
        scorer, texts = held["scorer"], [t or "" for t in column]
        if scorer is None:
            return pd.DataFrame({"score": [0.0] * len(texts), "toxic_spans": [[]] * len(texts)})
        scores, spans = [], []
        for first in range(0, len(texts), 2000):
            part = texts[first : first + 2000]
            for t, p in zip(part, scorer.marginals(part), strict=True):
                scores.append(float(1 / (1 + np.exp(-np.clip(np.dot(summary(p), scorer.model.layer), -60, 60)))))
                found = []
                if len(p) and p.max() >= least:
                    low = t.lower()
                    at = list(TOKEN.finditer(low))
                    home = range(len(t)) if len(low) == len(t) else np.repeat(np.arange(len(t)), [len(c.lower()) for c in t])
                    found = [{"start": int(home[at[i].start()]), "end": int(home[at[i].end() - 1]) + 1, "p": float(p[i])} for i in np.flatnonzero(p >= least).tolist()]
                spans.append(found)
        return pd.DataFrame({"score": scores, "toxic_spans": spans})

    df = docs.drop(*[c for c in docs.columns if c.lower() in {"score", "toxic_spans"}])
    return df.withColumn("_s", run(F.coalesce(F.col(f"`{text}`"), F.lit("")))).withColumns({"score": F.col("_s.score"), "toxic_spans": F.col("_s.toxic_spans")}).drop("_s")
