"""Non-negative positive-unlabelled learning of text classifiers, in numpy.

Training needs positives, unlabelled text and the class prior p; labels other than 1 are never read. With the sigmoid loss l and the
decision value g it minimises ``p E_pos l(g) + max(0, E_unl l(-g) - p E_pos l(-g))``; where the second part falls below zero its gradient
is turned round, so that the classifier can't win by memorising positives. The loss is bounded, so the difference in the second part isn't
lost in the spread of the values, which it is with the logistic loss where p is large. The risk is least where g > 0 for what is rather
of label 1; a score is the logistic function of g, so 0.5 is that border, and thresholds off it ask for a margin to either side.

The prior is estimated from both samples: a plain classifier tells positives from unlabelled text on one half of them; on the other
half the share of unlabelled text above a score, divided by the share of positives above it, is least where nothing but positives is,
and there it is the prior. Bounds of both shares keep thin tails out.

The model is additive: one-hot bins of a few shape features of a text, and words and beginnings of words whose share of documents
differs most between positives and the whole corpus. Nothing but the text is an input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checkpoint, forget, give_back, map_texts, partitions_for, slices, texts_of

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\xBF×÷]+")
DIGITS, UPPER, END = [*range(48, 58)], [*range(65, 91)], [33, 63]
SYMBOLS, MARKS = [*b"#$%&*@~^_=+<>/\\{}[]"], [*b".,;:'\"()-"]


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the rows that are fitted (at most twice as many) and ``sample_bytes`` the texts among
    them; ``words`` bounds the chosen features of words, ``candidates`` those that are counted over the corpus, and ``lift`` is the least
    z-score of their difference; ``neutral`` is the score of all texts, and the prior, where nothing is known; ``doubt`` is the
    probability that a share's bound of the prior's estimate fails."""

    positives: int = 3000
    unlabelled: int = 6000
    sample_bytes: int = 65_536
    words: int = 512
    candidates: int = 4096
    lift: float = 6.0
    bins: int = 12
    steps: int = 400
    rate: float = 0.05
    ridge: float = 1e-4
    neutral: float = 0.5
    doubt: float = 0.1


class Wanted(dict):
    """Of each word those of its features that are wanted, remembered for a bounded number of words."""

    def __init__(self, wanted: Iterable[int]):
        super().__init__()
        self.wanted = {f // 4 for f in wanted}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in features(word) if f in self.wanted)
        if len(self) < 300_000:
            self[word] = found
        return found


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    words: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        """Scores of a list of texts."""
        of = Wanted(self.words).__getitem__

        def score(texts: list[str]) -> np.ndarray:
            g = np.full(len(texts), self.bias)
            if self.edges and texts:
                x = np.array([shape(t) for t in texts])
                for j, (e, w) in enumerate(zip(self.edges, self.bins, strict=True)):
                    g += w[np.searchsorted(e, x[:, j])]
            if self.words:
                get = self.words.get
                g += [sum(get(f, 0.0) for f in levels(t, of)) for t in texts]
            return sigmoid(g)

        return score


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [zlib.crc32(b"=" + word.encode()), *(zlib.crc32(b"^" + word[:n].encode()) for n in range(3, 8) if len(word) > n)]


def levels(text: str, of: Callable[[str], Iterable[int]] = features) -> set[int]:
    """4 f + level for each feature f: 0 present, 1 in two different words, 2 and 3 in at least a hundredth and three of them."""
    words = set(WORD.findall(text.lower()))
    counts = Counter(chain.from_iterable(map(of, words)))
    out = set()
    for f, n in counts.items():
        out.add(4 * f)
        if n > 1:
            out.add(4 * f + 1)
            if 100 * n >= len(words):
                out.add(4 * f + 2)
            if 100 * n >= 3 * len(words):
                out.add(4 * f + 3)
    return out


def shape(text: str) -> list[float]:
    """Features of a text's form; all zero for the empty text."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * 13
    n, k = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = text.split("\n")
    of = lambda codes: float(counts[codes].sum()) / n
    return [
        float(np.log1p(k)), len(text) / k, of(UPPER), of(DIGITS), of([124]), of(END), of(SYMBOLS), of(MARKS), float(counts[128:].sum()) / n,
        float(np.log(len(set(words)) + 1) / np.log(k + 1)), sum(map(eq, words, words[1:])) / k, 1 - len(set(lines)) / len(lines), len(lines) / k,
    ]


def in_fold(id_col: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss(z: np.ndarray) -> np.ndarray:
    """The sigmoid loss."""
    return sigmoid(-z)


def risk(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of scores of positives and unlabelled texts, before the second is held at zero."""
    return prior * float(loss(pos).mean()), float(loss(-unl).mean() - prior * loss(-pos).mean())


def slopes(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What the descent takes as the risk's gradient by the scores: of both parts, or of the second alone, turned round, where that is
    below zero."""
    steep = lambda z: sigmoid(z) * sigmoid(-z)  # noqa: E731  the derivative of l(-z), and of -l(z)
    p, u = prior * steep(pos) / len(pos), steep(unl) / len(unl)
    return (p, -u) if risk(pos, unl, prior)[1] < 0 else (-2 * p, u)


def plain_slopes(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the mean logistic losses of telling positives from unlabelled texts."""
    return -sigmoid(-pos) / len(pos), sigmoid(unl) / len(unl)


def descend(pos: np.ndarray, unl: np.ndarray, gradient: Callable, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by steps of Adam over whole samples."""
    w, b = np.zeros(pos.shape[1]), 0.0
    mean, spread, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, settings.steps + 1):
        rp, ru = gradient(pos @ w + b, unl @ w + b)
        gw, gb = rp @ pos + ru @ unl + settings.ridge * w, float(rp.sum() + ru.sum())
        mean, spread = 0.9 * mean + 0.1 * gw, 0.999 * spread + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = settings.rate / (1 - 0.9**t)
        w -= step * mean / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def estimated_prior(pos: np.ndarray, unl: np.ndarray, settings: Settings) -> float:
    """The prior from scores of positives and unlabelled texts that the scores' classifier has not seen: the least ratio of the shares
    above a score, where both shares' bounds are taken into account. ``settings.neutral`` where the samples are too small to tell."""
    if not len(pos) or not len(unl):
        return settings.neutral
    at = np.unique(pos)
    p = 1 - np.searchsorted(np.sort(pos), at, "left") / len(pos)
    u = 1 - np.searchsorted(np.sort(unl), at, "left") / len(unl)
    bound = lambda n: np.sqrt(np.log(4 / settings.doubt) / (2 * n))
    sure = p > 2 * bound(len(pos))
    if not sure.any():
        return settings.neutral
    upper = (u[sure] + bound(len(unl))) / (p[sure] - bound(len(pos)))
    best = int(np.argmin(upper))
    return float(np.clip(u[sure][best] / p[sure][best], 0.01, 0.99))


def one_hot(shapes: np.ndarray, columns: list[list[int]], n_words: int, edges: list[np.ndarray]) -> np.ndarray:
    """The model's inputs: bins of each shape feature, then words."""
    parts = [(np.searchsorted(e, shapes[:, j])[:, None] == np.arange(len(e) + 1)).astype(np.float32) for j, e in enumerate(edges)]
    has = np.zeros((len(shapes), n_words), np.float32)
    for i, at in enumerate(columns):
        has[i, at] = 1
    return np.hstack([*parts, has])


def fit_rows(x: list[list[float]], columns: list[list[int]], chosen: list[int], role: np.ndarray, prior: float | None, settings: Settings) -> Model:
    """The model from positives (role 1) and unlabelled texts (0): their shapes ``x`` and, in ``columns``, which of the ``chosen`` words
    they hold. The prior is estimated where none is given."""
    shapes = np.array(x)
    edges = [np.unique(np.quantile(shapes[role == 0, j], np.linspace(0, 1, settings.bins + 1)[1:-1])) for j in range(shapes.shape[1])]
    m = one_hot(shapes, columns, len(chosen), edges)
    pos, unl = m[role == 1], m[role == 0]
    if prior is None:
        half = lambda a, k: a[k::2]
        if len(pos) > 1 and len(unl) > 1:
            w, b = descend(half(pos, 0), half(unl, 0), plain_slopes, settings)
            prior = estimated_prior(half(pos, 1) @ w + b, half(unl, 1) @ w + b, settings)
        else:
            prior = settings.neutral
    w, b = descend(pos, unl, lambda p, u: slopes(p, u, prior), settings)
    bins, at = [], 0
    for e in edges:
        bins.append(w[at : at + len(e) + 1])
        at += len(e) + 1
    return Model(edges, bins, dict(zip(chosen, map(float, w[at:]), strict=True)), b)


def level_counts(texts: DataFrame, of: Callable[[], Callable[[str], Iterable[int]]], wanted: set[int] | None = None) -> DataFrame:
    """(word, role, n): of how many texts (role, text) each feature is one; a task sends each feature once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: dict[int, Counter] = {}
        features_of = of()
        for batch in batches:
            for part in slices(batch, 1):
                for role, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = levels(text, features_of)
                    seen.setdefault(role, Counter()).update(found if wanted is None else found & wanted)
            give_back()
        for role, n in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([role] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["word", "role", "n"])
        seen.clear()
        give_back()

    return texts.select("role", "text").mapInArrow(count, "word bigint, role int, n bigint").groupBy("word", "role").agg(F.sum("n").alias("n"))


def z_scores(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    pooled = (p + u + 1) / (n_p + n_u + 2)
    return np.abs(p / n_p - u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))


def chosen_words(sample: DataFrame, docs: DataFrame, total: int, settings: Settings) -> list[int]:
    """Hashes, ascending, of the features of words whose share of documents differs most between positives and all documents.

    Candidates are those whose shares differ by half of ``lift`` in the sample, at most ``candidates`` of them; they are then counted in
    every document of the corpus.
    """
    sizes = {r.role: r.n for r in sample.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u or not settings.words:
        return []
    both = level_counts(sample, lambda: features).groupBy("word").agg(F.sum(F.col("n") * F.col("role")).alias("p"), F.sum(F.col("n") * (1 - F.col("role"))).alias("u")).filter("p + u >= 5")
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    some = {r.word: r.p for r in both.select("word", "p", z.alias("z")).filter(F.col("z") >= settings.lift / 2).orderBy(F.desc("z"), "word").limit(settings.candidates).collect()}
    if not some:
        return []
    wanted = docs.sparkSession.sparkContext.broadcast(set(some))
    everywhere = level_counts(docs.select(F.lit(0).alias("role"), "text"), lambda: Wanted(wanted.value).__getitem__, wanted_of(wanted))
    u = {r.word: r.n for r in everywhere.collect()}  # at most the candidates
    words = sorted(some)
    score = z_scores(np.array([some[w] for w in words], float), np.array([u.get(w, 0) for w in words], float), n_p, max(total, 1))
    best = sorted(zip(-score, words, strict=True))[: settings.words]
    return sorted(w for z, w in best if -z >= settings.lift)


def wanted_of(broadcast):
    """The broadcast set where it is looked up, in the worker."""

    class Lazy:
        def __rand__(self, found: set[int]) -> set[int]:
            return found & broadcast.value

    return Lazy()


def fit(docs: DataFrame, labels: DataFrame, trusted: Column, settings: Settings) -> Model:
    """A model from (doc_id, text) and the ids that (doc_id, label) labels 1 where ``trusted`` holds; other labels are not read.

    Documents are read twice: for the sample, and to count words. Without positives, or with no other text, all texts score
    ``settings.neutral``.
    """
    neutral = Model(bias=float(np.log(settings.neutral / (1 - settings.neutral))))
    ones = labels.filter(trusted).filter("doc_id is not null and label = 1").select("doc_id").distinct()
    ones = checkpoint(ones.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.positives))
    if ones.isEmpty():
        return neutral
    total = docs.count()
    drawn = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(max(total, 1))), F.lit(0)) < settings.unlabelled
    marked = docs.join(F.broadcast(ones.withColumn("one", F.lit(True))), "doc_id", "left").withColumn("drawn", drawn)
    marked = marked.filter((F.col("one") | F.col("drawn")) & (F.octet_length("text") <= settings.sample_bytes))
    roles = F.array_compact(F.array(F.when(F.col("one"), F.lit(1)), F.when(F.col("drawn"), F.lit(0))))
    sample = checkpoint(marked.select("doc_id", "text", F.explode(roles).alias("role")).repartition(partitions_for(docs), "doc_id"))
    chosen = chosen_words(sample, docs, total, settings)

    def make() -> Callable[[list], dict]:
        forget()
        at = {h: i for i, h in enumerate(chosen)}
        of = Wanted(chosen).__getitem__
        return lambda texts: {"shape": [shape(t) for t in texts], "columns": [sorted(at[h] for h in levels(t, of) if h in at) if at else [] for t in texts]}

    rows = map_texts(sample, make, {"shape": "array<double>", "columns": "array<int>"}, keep=("doc_id", "role"))
    most = 2 * (settings.positives + settings.unlabelled)  # rows that repeat an id can't make it more
    table = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "role").limit(most).toArrow()
    role = np.array(table["role"].to_pylist(), int)
    if not (role == 1).any() or not (role == 0).any():
        return neutral
    return fit_rows(table["shape"].to_pylist(), table["columns"].to_pylist(), chosen, role, None, settings)


def scored(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, rest: int, threshold: float, settings: Settings, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the ``carried`` columns of ``docs``: every row of ``docs`` scored by a model that saw no label of a held-out id."""
    texts = texts_of(docs, id_col, text_col)
    model = fit(texts, labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")), ~in_fold(F.col("doc_id"), mod, rest), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], dict]:
        forget()
        score = shared.value.scorer()
        return lambda texts: {"score": score(texts).tolist()}

    rows = texts_of(docs, id_col, text_col, carried) if carried else texts
    return map_texts(rows, make, {"score": "double"}, keep=("doc_id", *carried)).select("doc_id", in_fold(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carried)
