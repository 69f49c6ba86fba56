"""Evaluation texts leaking into training text: latent semantic retrieval of passages, then sequence and answer checks."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.staging import stage

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased NFKC form; none for null."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


class _Numbers(dict):
    """Word → 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 500_000) -> None:
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return n


def _flat(texts: list[list[str]], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text ends; a word's feature is its hash modulo the features."""
    flat = np.fromiter((numbers[w] for t in texts for w in t), np.uint64)
    return flat, np.cumsum([len(t) for t in texts], dtype=np.int64)


def _features(flat: np.ndarray, features: int) -> np.ndarray:
    return (flat % np.uint64(features)).astype(np.int64)


def longest_common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, on bit vectors."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def longest_common_run(a: list[str], b: list[str]) -> int:
    """Length of the longest run of consecutive words that both hold."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    best, ends = 0, {}
    for w in b:
        ends = {i: ends.get(i - 1, 0) + 1 for i in at.get(w, ())}
        best = max(best, max(ends.values(), default=0))
    return best


def passages(lengths: np.ndarray, size: int) -> np.ndarray:
    """Passage number of every word: each text is cut in runs of at most size words."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    per = -(-lengths // size)
    return np.repeat(np.cumsum(per) - per, lengths) + place // size


def sketch_of(flat: np.ndarray, passage: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """AᵀAΩ of the TF-IDF matrix A of passages (rows of norm 1), whole; features × columns."""
    if not len(flat):
        return np.zeros_like(omega)
    n, d = int(passage[-1]) + 1, len(idf)
    cell, tf = np.unique(passage * d + flat, return_counts=True)
    row, col = cell // d, cell % d
    w = tf * idf[col]
    w /= np.sqrt(np.bincount(row, w * w, n))[row]
    y = np.stack([np.bincount(row, w * omega[col, j], n) for j in range(omega.shape[1])], 1)
    return np.stack([np.bincount(col, w * y[row, j], d) for j in range(omega.shape[1])], 1)


def right_vectors(omega: np.ndarray, z: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A from Z = AᵀAΩ (randomised, one pass, Nyström form)."""
    shift = 1e-9 * max(1e-30, np.linalg.norm(z))
    z = z + shift * omega
    c = omega.T @ z
    vals, vecs = np.linalg.eigh((c + c.T) / 2)
    keep = vals > 1e-12 * max(vals.max(), 1e-300)
    u, _, _ = np.linalg.svd(z @ (vecs[:, keep] / np.sqrt(vals[keep])), full_matrices=False)
    return u[:, :rank]


def tokenised(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, text and the 64-bit hashes of the words (binary) of every text that has words."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("words", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            flat, ends = _flat([words_of(t) for t in batch.column(1).to_pylist()], numbers)
            offsets = np.r_[0, ends] * 8
            rows = np.flatnonzero(np.diff(offsets))
            wide = offsets.astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(wide), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], schema.names).take(pa.array(rows))

    return df.select(key, text).mapInArrow(cut, schema)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of hashes, and the number per text."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint64), np.array([len(v) // 8 for v in values], np.int64)


def document_frequencies(df: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """Texts per hashed feature, and texts, over a whole tokenised table; at most one number per feature comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(features, np.int64), 0
        for batch in batches:
            flat, lengths = _hashes(batch.column(0))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            seen += np.bincount(np.unique(doc * features + _features(flat, features)) % features, minlength=features)
            n += len(lengths)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, seen[some]])], ["feature", "n"])

    table = df.select("words").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(table.column("feature")), np.asarray(table.column("n"))
    out = np.zeros(features, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def corpus_sketch(df: DataFrame, idf: np.ndarray, omega: np.ndarray, size: int) -> np.ndarray:
    """AᵀAΩ over the passages of a whole tokenised table; each task sends one features × columns block, summed in the shuffle."""
    features, columns = omega.shape
    shared = df.sparkSession.sparkContext.broadcast((idf, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_idf, own_omega = shared.value
        z = np.zeros((features, columns))
        for batch in batches:
            flat, lengths = _hashes(batch.column(0))
            z += sketch_of(_features(flat, features), passages(lengths, size), own_idf, own_omega)
        some = np.flatnonzero(np.abs(z).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(z[some, j].astype(np.float32)) for j in range(columns))], ["feature", *(f"z{j}" for j in range(columns))])

    names = [f"z{j}" for j in range(columns)]
    parts = df.select("words").mapInArrow(sketch, "feature long, " + ", ".join(f"{c} float" for c in names))
    table = parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    z = np.zeros((features, columns))
    z[np.asarray(table.column("feature"))] = np.stack([np.asarray(table.column(c)) for c in names], 1) if table.num_rows else 0
    return z


def window_rows(latent: np.ndarray, flat: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Unit latent vectors of the windows of words beginning at starts; equal windows have equal ones."""
    x = np.zeros((len(starts), latent.shape[1]))
    for i in range(window):
        x += latent[flat[starts + i]]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.maximum(size, 1e-300)).astype(np.float32)


def _ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in its row) of every element of rows of the given lengths."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@dataclass
class Side:
    """One block of evaluation items as it is broadcast; its size is bounded by the words of a block."""

    ids: list
    words: list[list[str]]
    passages: list[list[str]]  # of all items, one after the other
    owner: np.ndarray  # item of each passage
    vocabulary: np.ndarray  # sorted hashes of the items' words
    codes: list[np.ndarray]  # words of each passage, as places in the vocabulary
    answers: list[np.ndarray]  # the rarest quarter of a passage's distinct words, rarest first
    led_by: np.ndarray  # passages in the order of the rarest words of their answers
    led: np.ndarray  # where each word's passages begin in led_by
    hashes: np.ndarray  # distinct windows × words
    holders: np.ndarray  # passages of all windows, one after the other
    first: np.ndarray  # where each window's passages begin in holders
    centres: np.ndarray  # of the cells of windows in latent space
    cells: list[np.ndarray]  # windows of each cell
    vectors: np.ndarray  # latent unit vectors of the windows


def item_side(rows: list[tuple], latent: np.ndarray, idf: np.ndarray, window: int, size: int, seed: int) -> Side:
    """Windows, passages and cells of items (id, words)."""
    features, numbers = len(idf), _Numbers()
    flat, ends = _flat([w for _, w in rows], numbers)
    lengths = np.diff(np.r_[0, ends])
    begins = ends - lengths
    vocabulary = np.unique(flat)
    parts, owner, where = [], [], []
    for i, (_, w) in enumerate(rows):
        n = max(1, round(len(w) / size))  # passages of about the size, none of them short
        cuts = [len(w) * j // n for j in range(n + 1)]
        for a, b in zip(cuts, cuts[1:]):
            parts.append(w[a:b])
            owner.append(i)
            where.append((int(begins[i]) + a, int(begins[i]) + b))
    codes = [np.searchsorted(vocabulary, flat[a:b]) for a, b in where]
    weight = idf[_features(vocabulary, features)]
    answers = []
    for c in codes:
        rare = np.unique(c)
        rare = rare[np.lexsort((vocabulary[rare], -weight[rare]))]
        answers.append(rare[: max(1, len(rare) // 4)])
    leads = np.array([a[0] for a in answers])
    led_by = np.argsort(leads, kind="stable")
    led = np.searchsorted(leads[led_by], np.arange(len(vocabulary) + 1))
    # every window of an item belongs to the passages it touches
    item, place = _ranges(lengths - window + 1)
    starts = begins[item] + place
    table = flat[starts[:, None] + np.arange(window)]
    distinct, of = np.unique(table, axis=0, return_inverse=True)
    lo, hi = np.array(where).T
    head, tail = np.searchsorted(hi, starts, side="right"), np.searchsorted(lo, starts + window - 1, side="right")
    which, step = _ranges(tail - head)
    pairs = np.unique(of.ravel()[which] * len(parts) + head[which] + step)
    first = np.searchsorted(pairs, np.arange(len(distinct) + 1) * len(parts))
    vectors = window_rows(latent, _features(distinct.ravel(), features), np.arange(len(distinct)) * window, window)
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(len(vectors), math.ceil(math.sqrt(len(vectors)))), replace=False)]
    sample = vectors[rng.choice(len(vectors), min(len(vectors), 20_000), replace=False)]
    for _ in range(6):
        nearest = (sample @ centres.T).argmax(1)
        used = np.unique(nearest)
        centres = np.stack([sample[nearest == c].sum(0) for c in used])
        centres = np.unique(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30), axis=0)
    nearest = (vectors @ centres.T).argmax(1)
    cells = [np.flatnonzero(nearest == c) for c in range(len(centres))]
    return Side([i for i, _ in rows], [w for _, w in rows], parts, np.array(owner), vocabulary, codes, answers, led_by, led, distinct, pairs % len(parts), first, centres, cells, vectors)


def near_windows(side: Side, x: np.ndarray, least: np.ndarray, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, item window, cosine) of cosine at least the row's least, in the nearest cells of every row."""
    s = x @ side.centres.T
    tops = []
    for _ in range(min(probes, s.shape[1])):
        tops.append(s.argmax(1))
        s[np.arange(len(s)), tops[-1]] = -2
    for top in tops:
        order = np.argsort(top, kind="stable")
        cuts = np.searchsorted(top[order], np.arange(len(side.cells) + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            rows, own = order[cuts[c] : cuts[c + 1]], side.cells[c]
            if len(own):
                cos = x[rows] @ side.vectors[own].T
                i, j = np.nonzero(cos >= least[rows, None])
                yield rows[i], own[j], cos[i, j]


def _retrieve(shared, latent_of, schema: T.StructType, window: int, least_lcs: float, least_cosine: float, probes: int, chunk: int = 32_768):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield from searched(shared.value, latent_of.value, batch.slice(at, 2000))

    def searched(e: Side, latent: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        features, n_parts, v = len(latent), len(e.passages), len(e.vocabulary)
        hashes, lengths = _hashes(batch.column(2))
        begins = np.cumsum(lengths) - lengths
        flat = _features(hashes, features)
        at = np.minimum(np.searchsorted(e.vocabulary, hashes), v - 1)
        known = e.vocabulary[at] == hashes
        held = np.unique(np.repeat(np.arange(len(lengths)), lengths)[known] * v + at[known])  # (document, word) of the items' words
        # a paraphrase holds the rarest word of the passage's answer: other pairs count only where windows are equal
        n = np.diff(e.led)[held % v]
        which, step = _ranges(n)
        able = np.zeros((len(lengths), n_parts), bool)
        able[held[which] // v, e.led_by[e.led[held[which] % v] + step]] = True
        floor = np.where(able.any(1), np.float32(least_cosine), np.float32(0.999))
        near, cosines, same = [], [], []
        for size in range(1, window + 1):
            docs = np.flatnonzero(lengths >= window if size == window else lengths == size)
            if not len(docs):
                continue
            inner, place = _ranges(lengths[docs] - size + 1)
            own, starts = docs[inner], begins[docs][inner] + place
            for lo in range(0, len(starts), chunk):
                d, first = own[lo : lo + chunk], starts[lo : lo + chunk]
                for i, w, cos in near_windows(e, window_rows(latent, flat, first, size), floor[d], probes):
                    which, step = _ranges(e.first[w + 1] - e.first[w])
                    doc, part = d[i][which], e.holders[e.first[w][which] + step]
                    fine = able[doc, part]
                    near.append(doc[fine] * n_parts + part[fine])
                    cosines.append(cos[which][fine])
                    if size == window:
                        equal = np.flatnonzero(cos > 0.999)
                        alike = np.zeros(len(i), bool)
                        alike[equal] = (hashes[first[i[equal]][:, None] + np.arange(window)] == e.hashes[w[equal]]).all(1)
                        same.append(np.unique(doc[alike[which]] * len(e.ids) + e.owner[part[alike[which]]]))
        if not near:
            return
        pairs, back = np.unique(np.concatenate(near), return_inverse=True)
        best = np.zeros(len(pairs), np.float32)
        np.maximum.at(best, back, np.concatenate(cosines))
        yield from checked(e, batch, held, pairs, best, np.unique(np.concatenate(same)).tolist() if same else [])

    def checked(e: Side, batch: pa.RecordBatch, held: np.ndarray, pairs: np.ndarray, best: np.ndarray, same: list[int]) -> Iterator[pa.RecordBatch]:
        n_parts, n_items, v = len(e.passages), len(e.ids), len(e.vocabulary)
        has = lambda code: held[np.minimum(np.searchsorted(held, code), len(held) - 1)] == code
        texts: dict[int, list[str]] = {}

        def words(doc: int) -> list[str]:
            if doc not in texts:
                texts[doc] = words_of(batch.column(1)[doc].as_py())
            return texts[doc]

        found: dict[int, tuple[float, int, int, float]] = {}  # (document, item) → share, lcs, words, cosine of the best passage
        for doc, part, cosine in zip((pairs // n_parts).tolist(), (pairs % n_parts).tolist(), best.tolist()):
            mine = e.codes[part]
            if has(doc * v + e.answers[part]).all() and has(doc * v + mine).sum() >= least_lcs * len(mine):
                lcs = longest_common_subsequence(e.passages[part], words(doc))
                if lcs >= least_lcs * len(mine):
                    key = doc * n_items + int(e.owner[part])
                    found[key] = max(found.get(key, (0.0, 0, 0, 0.0)), (lcs / len(mine), lcs, len(mine), cosine))
        out = []
        for key in sorted({*same, *found}):
            doc, item = divmod(key, n_items)
            run = longest_common_run(e.words[item], words(doc))
            if run >= window or key in found:
                whole = len(e.words[item])
                _, lcs, size, cosine = found.get(key) or (0, longest_common_subsequence(e.words[item], words(doc)), whole, 1.0)
                out.append((e.ids[item], doc, "passage" if run >= window else "paraphrase", 1.0 if run >= window else min(1.0, cosine), run, lcs, size))
        if out:
            kinds = [None, None, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            arrays[1] = batch.column(0).take(arrays[1])
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return search


def leaking_documents(docs: DataFrame, doc_id: str, text: str, items: DataFrame, eval_id: str, eval_text: str, window: int = 8, least_lcs: float = 0.8, least_cosine: float = 0.9, probes: int = 3, rank: int = 32, oversample: int = 8, features: int = 1 << 14, passage: int = 32, block_words: int = 200_000, seed: int = 7) -> DataFrame:
    """Documents that hold a passage of an evaluation item: eval_id, doc_id, kind, cosine, run, lcs, words.

    Latent space: TF-IDF of passages on hashed words, with document frequencies over all texts; right singular vectors by a
    randomised SVD over all passages of the corpus and the items. The windows of consecutive words of the items are grouped
    in cells of that space. Every window of every document (the whole of a shorter one) looks in its probes
    nearest cells for item windows of at least least_cosine. The passages of the items that are found this way are checked:

    kind passage: a common run of words is at least as long as the window. Equal windows have equal vectors, hence the same
    nearest cell and cosine 1, so that no such case is lost. kind paraphrase: the document holds all of the answer of a
    passage of the item (its rarest quarter of words) and a common subsequence of at least least_lcs of its words;
    the search is approximate here, its recall against brute force is in the README. lcs and words are those of the best
    passage, of the whole item where no passage is matched that far; cosine is the best of the item's windows found.

    Items with fewer words than the window, null and empty texts are in no case. Repeated texts and items that share a
    passage each have their own row. Items are taken in blocks of about block_words words; each block is one search
    over all documents, so more items mean more passes, not more memory. The words of both sides are staged, and
    the jobs of the latent space run, when the DataFrame is built.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [T.StructField("eval_id", items.schema[eval_id].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("kind", T.StringType()), T.StructField("cosine", T.DoubleType())]
        + [T.StructField(c, T.IntegerType()) for c in ("run", "lcs", "words")]
    )
    held = stage(tokenised(items, eval_id, eval_text).where(F.octet_length("words") >= 8 * window), "item-words")
    n_words = held.agg(F.sum(F.octet_length("words"))).first()[0]
    if not n_words:
        return spark.createDataFrame([], schema)
    corpus = stage(tokenised(docs, doc_id, text), "document-words")
    both = corpus.select("words").unionAll(held.select("words"))
    df, n = document_frequencies(both, features)
    idf = np.log((n + 1) / (df + 1)) + 1
    omega = np.random.default_rng(seed).standard_normal((features, rank + oversample))
    # two columns of small random weights keep windows of words outside the leading directions apart from zero
    latent = idf[:, None] * np.hstack([right_vectors(omega, corpus_sketch(both, idf, omega, passage), rank), 1e-4 * omega[:, :2]])
    latent_of = spark.sparkContext.broadcast(latent)
    n_blocks, out = -(-n_words // (8 * block_words)), None
    for b in range(n_blocks):
        own = held if n_blocks == 1 else held.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b)
        rows = sorted(((r["id"], words_of(r["text"])) for r in own.select("id", "text").collect()), key=str)
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(item_side(rows, latent, idf, window, passage, seed))
        part = corpus.mapInArrow(_retrieve(shared, latent_of, schema, window, least_lcs, least_cosine, probes), schema)
        if n_blocks > 1:
            part = stage(part, f"leaks-{b}")
            shared.destroy()
        out = part if out is None else out.unionAll(part)
    return out
