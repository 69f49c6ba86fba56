"""Text quality statistics, and boosted trees that tell prose from lists, tables and junk.

The trees see statistics only, not the signs of the stated rule, and learn from labels of another origin: texts of the
corpus as they are count as prose, copies of them in which a structure is planted count as junk. Their probabilities are
calibrated on texts labelled by hand.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.checked import CHECKED

# Fixed values of the problem: line ends and the limits of the four signs of junk.
LINE_ENDS = (".", "!", "?", "…", "。", ";", ":", '"', "»", "”", ")")
MAX_SYMBOLS, MIN_LINE_ENDS, MIN_COMMON, MAX_LENGTH, MIN_LENGTH = 0.20, 0.40, 0.10, 12.0, 2.5

STATISTICS = ("n_words", "mean_word_length", "symbol_share", "line_end_share", "common_share", "n_lines")
SIGNS = ("many_symbols", "few_line_ends", "few_common", "odd_length")
_NOT_SYMBOL = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def statistics(text: str | None, common: frozenset[str]) -> tuple | None:
    """The six statistics of a text, None for a null or blank one."""
    words = text.split() if text else []
    if not words:
        return None
    solid = "".join(words)
    symbols = len(_NOT_SYMBOL.sub("", solid))
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    n_common = 0
    for w in words:
        if not (w[0].isalnum() and w[-1].isalnum()):
            w = _EDGES.sub("", w)
        n_common += w.lower() in common
    return len(words), len(solid) / len(words), symbols / len(solid), sum(s.endswith(LINE_ENDS) for s in lines) / len(lines), n_common / len(words), len(lines)


def signs(x: np.ndarray) -> np.ndarray:
    """The four signs of junk of rows of statistics."""
    return np.stack([x[:, 2] > MAX_SYMBOLS, x[:, 3] < MIN_LINE_ENDS, x[:, 4] < MIN_COMMON, (x[:, 1] > MAX_LENGTH) | (x[:, 1] < MIN_LENGTH)], axis=1)


MORE = ("digit_share", "marked_share", "distinct_share")
_DIGIT = re.compile(r"\d")
_MARKED = re.compile(r"^(?:[-*•·▪]|[0-9]+[.)])\s|\t|[|;›]|\.{4}|:\s*[^\s]*[0-9]|^[\[{<]")


def structure(text: str) -> tuple[float, float, float]:
    """Share of digits, share of lines with a bullet, number or separator, and distinct words over words, of a text that isn't blank."""
    words = text.split()
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    size = sum(map(len, words))
    return len(_DIGIT.findall(text)) / size, sum(_MARKED.search(s) is not None for s in lines) / len(lines), len(set(words)) / len(words)


_CODE, _MARKS, _DIGITS = "0123456789ABCDEFGHKLMNPRSTUVXYZ", "#$%&*+/<=>[]^{|}~ ", "abcdefghjkmnpqrstuvwxyzABCDEFGHKLMNPRSTUVXYZ0123456789+/"


def planted(text: str, seed: int) -> str:
    """The words of a text in a structure that is no prose: a list, table, path, index, repetition or noise, chosen by the seed."""
    draw = random.Random(seed)
    words = [w for w in (_EDGES.sub("", w) for w in text.split()) if w] or ["x"]
    some = lambda n: draw.choices(words, k=n)
    code = lambda: "".join(draw.choices(_CODE, k=draw.randrange(2, 8)))
    n, kind = draw.randrange(3, 12), draw.randrange(10)
    if kind == 0:
        bullet = draw.choice("*•-")
        return "\n".join(f"{bullet} {' '.join(some(draw.randrange(1, 4)))}" for _ in range(n))
    if kind == 1:
        return "\n".join(f"{i + 1}. {' '.join(some(2))} {draw.randrange(999)}" for i in range(n))
    if kind == 2:
        cell = draw.choice([" | ", "\t", ";", ","])
        return "\n".join(cell.join([some(1)[0], code(), str(draw.randrange(999)), f"{draw.random():.3f}"]) for _ in range(n))
    if kind == 3:
        return "\n".join(f"{some(1)[0]}: {code()}-{draw.randrange(99)}" for _ in range(n))
    if kind == 4:
        return draw.choice([" › ", " | ", " / "]).join(some(n + 4))
    if kind == 5:
        return "\n".join(f"{some(1)[0]} {'.' * draw.randrange(4, 20)} {draw.randrange(400)}" for _ in range(n))
    if kind == 6:
        return " ".join(some(1) * (n + 5))
    if kind == 7:
        return "".join(draw.choices(_MARKS, k=20 * n)) + "#"
    if kind == 8:
        return " ".join("".join(draw.choices(_DIGITS, k=draw.choice([1, 60]))) for _ in range(n))
    return "".join(f"<b class='{code().lower()}'>{w}</b>" for w in some(n)) if draw.random() < 0.5 else "{" + ", ".join(f'"{w}": {draw.randrange(999)}' for w in some(n)) + "}"


@dataclass
class Trees:
    """Gradient-boosted trees of fixed depth for log-odds, with a fitted calibration."""

    features: np.ndarray  # rounds × inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # rounds × leaves
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Uncalibrated log-odds."""
        out = np.full(len(x), self.base)
        inner, rows = self.features.shape[1], np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), int)
            for _ in range(int(math.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of junk."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    inner = 2**depth - 1
    p0 = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = math.log(p0 / (1 - p0))
    fs, cs, vs = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    score = np.full(len(x), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.full(wide, 1e-9)
            for f in range(x.shape[1]):
                k = len(edges[f]) + 1
                if k < 2:
                    continue
                hg = np.bincount(local * k + binned[:, f], g, wide * k).reshape(wide, k)
                hh = np.bincount(local * k + binned[:, f], h, wide * k).reshape(wide, k)
                lg, lh = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                tg, th = hg.sum(1, keepdims=True), hh.sum(1, keepdims=True)
                gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                for n in np.flatnonzero(top > best):
                    best[n], fs[t, first + n], cs[t, first + n] = top[n], f, edges[f][at[n]]
            node = 2 * node + 1 + (x[np.arange(len(x)), fs[t][node]] > cs[t][node])
        leaf = node - inner
        vs[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += vs[t][leaf]
    return Trees(fs, cs, vs, base)


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> Trees:
    """Platt scaling of the margin on held-out rows, with Platt's smoothed targets; ridge pulls towards no change."""
    m, pos = model.margin(x), float(y.sum())
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-12)
        hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + np.eye(2) * ridge
        step = np.linalg.solve(hess, [((p - goal) * m).sum() + ridge * (a - 1), (p - goal).sum() + ridge * b])
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(a), float(b)
    return model


def common_set(words: DataFrame, column: str = "word", limit: int = 100_000) -> frozenset[str]:
    """The common words of all languages; raises beyond limit, as they are broadcast."""
    rows = words.select(F.lower(column).alias("w")).where("w is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} common words")
    return frozenset(r["w"] for r in rows)


def text_statistics(df: DataFrame, doc_id: str, text: str, common: frozenset[str]) -> DataFrame:
    """doc_id, the statistics and the number of signs of junk.

    One row per row. A null, empty or blank text has n_words and n_lines 0 and nulls elsewhere. Whole
    texts are read; no shuffle.
    """
    return _measured(df, doc_id, text, common)


def judged_texts(df: DataFrame, doc_id: str, text: str, words: DataFrame, fit_rows: int = 10_000) -> DataFrame:
    """text_statistics and p_junk, the calibrated probability of the trees that the text isn't prose.

    The trees are fitted when the DataFrame is built, on a bounded sample (fit_junk_model). p_junk is null for null and blank
    texts, and everywhere if no text could be sampled. No row is left out.
    """
    common = common_set(words)
    return _measured(df, doc_id, text, common, (fit_junk_model(df, doc_id, text, common, fit_rows),))


def _measured(df: DataFrame, doc_id: str, text: str, common: frozenset[str], judge: tuple[Trees | None, ...] = ()) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((common, judge))
    kinds = [T.LongType() if c in ("n_words", "n_lines") else T.DoubleType() for c in STATISTICS]
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *map(T.StructField, STATISTICS, kinds), T.StructField("n_signs", T.LongType())] + [T.StructField("p_junk", T.DoubleType())] * len(judge))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [statistics(t, own) for t in texts]
            blank = np.array([r is None for r in rows], bool)
            x = np.array([r or (0.0,) * 6 for r in rows], float).reshape(-1, 6)
            columns = [batch.column(0)]
            for i, name in enumerate(STATISTICS):
                columns.append(pa.array(x[:, i].astype(np.int64)) if name in ("n_words", "n_lines") else pa.array(x[:, i], mask=blank))
            columns.append(pa.array(signs(x).sum(1).astype(np.int64), mask=blank))
            for model in trees:
                more = np.array([(0.0,) * 3 if b or model is None else structure(t) for t, b in zip(texts, blank)]).reshape(-1, 3)
                columns.append(pa.nulls(len(x), pa.float64()) if model is None else pa.array(model.probability(np.hstack([x, more])), mask=blank))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(doc_id, text).mapInArrow(measure, schema)


def fit_junk_model(df: DataFrame, doc_id: str, text: str, common: frozenset[str], fit_rows: int = 10_000) -> Trees | None:
    """Boosted trees fitted on about fit_rows texts, chosen by a hash of doc_id, and as many copies with a planted structure.

    A text as it stands is weakly labelled prose (a corpus holds some junk, which the trees must take as noise of the label),
    its copy with a planted structure is junk. Both are measured where the texts are; only numbers come to the driver. The
    probabilities are calibrated on the texts labelled by hand. None if no text could be sampled.
    """
    share = min(1.0, fit_rows / max(1, df.count()))
    sample = df.where(F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(1_000_000)) < F.lit(int(math.ceil(share * 1_000_000))))
    seeded = sample.select(text, F.pmod(F.xxhash64(doc_id, F.lit("plant")), F.lit(2**31)).alias("seed"))
    shared, names = df.sparkSession.sparkContext.broadcast(common), [*STATISTICS, *MORE]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if statistics(t, shared.value):
                    rows += [(*statistics(v, shared.value), *structure(v), junk) for v, junk in ((t, 0.0), (planted(t, seed), 1.0)) if v.strip()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)], [*names, "junk"])

    found = seeded.mapInArrow(measure, ", ".join(f"{c} double" for c in [*names, "junk"])).toArrow()
    if not found.num_rows:
        return None
    x = np.stack([np.asarray(found.column(c)) for c in names], axis=1)
    y = np.asarray(found.column("junk"))
    order = np.lexsort((*x.T, y))  # the same model whatever the order of the rows
    hand = np.array([(*statistics(t, common), *structure(t)) for t, _ in CHECKED])
    return calibrate(fit_trees(x[order], y[order]), hand, np.array([j for _, j in CHECKED], float), ridge=0.1)


def junk_texts(df: DataFrame, doc_id: str, text: str, words: DataFrame) -> DataFrame:
    """doc_id and p_junk of the texts that are not prose: of the judged texts those that show two of the four signs.

    The rule is exact and decides; p_junk is a measure and loses no row. Null and blank texts are in no case.
    """
    return judged_texts(df, doc_id, text, words).where("n_signs >= 2").select("doc_id", "p_junk")
