"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (a short built-in list, and words and word beginnings
learned from the labelled rows), how near the hits stand to second-person words, capitals,
punctuation, and obfuscation (signs or digits inside words, letters drawn out, letters spaced out).

Training. At most ``sample`` labelled rows are used, those of smallest hash of the id: a documented
bound, so that words counted and rows fitted on the driver stay bounded; counts of words are summed
on the executors. A lexicon has ``ENTRIES`` entries at most, those of the largest weight. Every row's features come from a lexicon learned without its fold, the trees' own
out-of-fold margins give the isotonic map, and then lexicon and trees are fitted to all of the sample.
Labels, language, source and id are no inputs of a score.

Defined cases: a null text is scored as an empty one; a row with a null label is not learned from;
with fewer than two classes the built-in list alone decides; a very long text is scored whole; equal
weights go by the entry's spelling, equal hashes by id; a document id that is repeated is scored row
by row; other columns are carried along, but one named as the score is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.llm.workers import tidy
from gridtrace.session import materialize

FOLDS = 4
ENTRIES = 4000
#: A short built-in list of insults, English, French, German and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting imbecile jerk dumb clown fool ugly vermin "
    "connard connasse salope abruti imbécile débile crétin idiote ordure raclure minable pourriture "
    "arschloch trottel vollidiot dummkopf abschaum wichser mistkerl schwachkopf versager drecksau "
    "gilipollas imbécil cabrón idiota estúpido escoria basura pendejo tarado inútil".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer eure tú ti contigo tus usted ustedes vosotros os".split()
)
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"[^\W\d_][@$*!|0134579]+[^\W\d_]")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_PLAIN = str.maketrans({"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "i", "!": "i", "|": "l", "3": "e", "7": "t", "9": "g"})
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SIGNS = re.compile(r"[!?]{2,}")
NAMES = (
    "words", "hits", "share", "weight", "most", "kinds", "listed", "near", "second", "capitals", "shouted", "marks", "questions", "runs",
    "signs", "hidden", "hidden_hits", "drawn", "spaced",
)


def entries_of(word: str) -> list[str]:
    """What a word is looked up by: itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6, 7) if len(word) > n)]


class Lookup(dict):
    """Word -> 0, 1 + entry, or -1 for a second-person word. Bounded."""

    MOST = 100_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.weights = [0.0]
        self.names = [""]
        self.listed = [False]

    def make_room(self) -> None:
        """Between texts only, so that codes stay valid within one."""
        if len(self) > self.MOST:
            self.clear()
            del self.weights[1:], self.names[1:], self.listed[1:]

    def __missing__(self, word: str) -> int:
        best = max((self.lexicon[e], e) for e in entries_of(word) if e in self.lexicon) if any(e in self.lexicon for e in entries_of(word)) else None
        if best is None and word in INSULTS:
            best = (2.0, word)
        if best:
            self.weights.append(best[0])
            self.names.append(best[1])
            self.listed.append(word in INSULTS)
            code = len(self.weights) - 1
        else:
            code = -1 if word in SECOND_PERSON else 0
        self[word] = code
        return code


def features(text: str, look: Lookup) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = len(words), len(text)
    per = 100.0 / max(n, 1)
    look.make_room()
    codes = np.fromiter((look[w] for w in words), dtype=np.int64, count=n)
    at = np.flatnonzero(codes > 0)
    second = np.flatnonzero(codes < 0)
    weights = [look.weights[codes[i]] for i in at]
    near = 0
    if len(at) and len(second):
        j = np.searchsorted(second, at)
        gap = np.minimum(np.abs(second[np.minimum(j, len(second) - 1)] - at), np.abs(second[np.maximum(j - 1, 0)] - at))
        near = int((gap <= 4).sum())
    hidden = hidden_hits = 0
    for m in _HIDDEN.finditer(text):
        hidden += 1
        s, e = m.start(), m.end()
        while s and not text[s - 1].isspace():
            s -= 1
        while e < chars and not text[e].isspace():
            e += 1
        plain = text[s:e].lower()
        for w in _WORD.findall(plain.translate(_PLAIN)) + _WORD.findall(plain.replace("*", "")):
            hidden_hits += look[w] > 0
    drawn = spaced = 0
    for m in _DRAWN.finditer(low):
        drawn += 1
    for m in _SPACED.finditer(low):
        spaced += 1
        hidden_hits += look["".join(c for c in m[0] if c.isalpha())] > 0
    upper = len(_CAPITAL.findall(text))
    shouted = sum(1 for w in _WORD.findall(text) if len(w) > 2 and w.isupper()) if upper > 2 else 0
    return [
        np.log1p(n), min(len(at), 20), len(at) * per, sum(weights) * per, max(weights, default=0.0), min(len({look.names[codes[i]] for i in at}), 20),
        sum(look.listed[codes[i]] for i in at) * per, near * per, len(second) * per, upper / max(chars, 1), shouted * per, text.count("!") * per, text.count("?") * per,
        len(_SIGNS.findall(text)) * per, sum(text.count(c) for c in "@#$%^&*~") * per, hidden * per, min(hidden_hits, 20), drawn * per, spaced * per,
    ]


# --- trees ---------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features, logistic loss."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    l2: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        bins = 65
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, dtype=np.int64)
            feat, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, bins, dtype=np.int64)
            for level in range(self.depth):
                k, first = 2**level, 2**level - 1
                best = np.zeros(k)
                for j in range(d):
                    key = node * bins + b[:, j]
                    gs = np.bincount(key, g, k * bins).reshape(k, bins).cumsum(axis=1)
                    hs = np.bincount(key, h, k * bins).reshape(k, bins).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(k), at]
                    for i in np.flatnonzero(top > best + 1e-9):
                        best[i], feat[first + i], cut[first + i] = top[i], j, at[i]
                f = feat[first + node]
                node = node * 2 + (b[np.arange(n), f] > cut[first + node])
            leaf = -self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.l2)
            margin += leaf[node]
            self.trees.append((feat, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
        out = np.full(n, self.base)
        rows = np.arange(n)
        for feat, cut, leaf in self.trees:
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (b[rows, feat[at]] > cut[at])
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising map from margin to probability: pooled neighbours, smoothed a little."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # positives, count, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    prior = y.mean()
    x = np.array([s / n for _, n, s in blocks])
    p = np.array([(k + prior) / (n + 1) for k, n, _ in blocks])
    return x, np.maximum.accumulate(p)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if self.trees is None:
            return np.clip(x[:, NAMES.index("listed")] / 4, 0, 1)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def lexicon_from(counts: dict[str, tuple[int, int]], rows: tuple[int, int], least: int = 3, most: int = ENTRIES) -> dict[str, float]:
    """Entries whose share among toxic rows is many times that among others, by their log odds."""
    out = []
    for e, (clean, toxic) in counts.items():
        if toxic < least:
            continue
        odds = np.log((toxic + 0.5) / (rows[1] + 1)) - np.log((clean + 0.5) / (rows[0] + 1))
        if odds > 1.6:
            out.append((odds * np.log1p(toxic), e, float(odds)))
    out.sort(reverse=True)
    return {e: odds for _, e, odds in out[:most]}


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, held_out: bool = True) -> Model:
    """A model from the labelled rows; with ``held_out``, none whose crc32 of the id is 0 modulo 5."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"))
    if held_out:
        rows = rows.where(~is_held_out("doc_id"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    rows = docs.sparkSession.createDataFrame(rows.collect(), rows.schema)  # at most ``sample`` rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(rows), "doc_id").select("t", "y", "fold")
    texts = materialize(texts, "labelled")  # so that the documents are read once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, bytearray] = {}  # a byte for each fold and label

        def out():
            counts = np.frombuffer(b"".join(sums.values()), dtype=np.uint8).reshape(len(sums), 2 * FOLDS)
            return pd.DataFrame({"e": list(sums), **{f"c{i}": counts[:, i].astype(np.int64) for i in range(2 * FOLDS)}})

        held = 0
        for b in batches:
            for t, y, fold in zip(b["t"], b["y"], b["fold"]):
                for e in {e for w in set(_WORD.findall(t.lower())) for e in entries_of(w)}:
                    if e not in sums:
                        sums[e] = bytearray(2 * FOLDS)
                    sums[e][2 * fold + (y > 0)] += 1
                held += 1
                if len(sums) > 100_000 or held == 255:
                    yield out()
                    sums.clear()
                    held = 0
        if sums:
            yield out()

    cols = [f"c{i}" for i in range(2 * FOLDS)]
    toxic = "+".join(cols[1::2])
    counted = texts.mapInPandas(tidy(count), "e string, " + ", ".join(f"{c} long" for c in cols)).groupBy("e").agg(*(F.sum(c).alias(c) for c in cols))
    counted = materialize(counted.where(f"{toxic} >= 3"), "entries")
    n = {(f, y): 0 for f in range(FOLDS) for y in (0, 1)}
    for r in texts.groupBy("fold", (F.col("y") > 0).cast("int").alias("y")).count().collect():
        n[r["fold"], r["y"]] = r["count"]
    if not all(sum(v for (_, y), v in n.items() if y == c) for c in (0, 1)):
        return Model({}, None, None)

    def lexicon(skip: int | None) -> dict[str, float]:
        """Chosen by the counts of the other folds alone, at most ``ENTRIES`` and at most twice as many looked at."""
        use = [f for f in range(FOLDS) if f != skip]
        rows = sum(n[f, 0] for f in use), sum(n[f, 1] for f in use)
        sums = counted.selectExpr("e", "+".join(f"c{2 * f}" for f in use) + " AS clean", "+".join(f"c{2 * f + 1}" for f in use) + " AS toxic").where("toxic >= 3")
        odds = f"ln((toxic + 0.5) / {rows[1] + 1}) - ln((clean + 0.5) / {rows[0] + 1})"
        best = sums.withColumn("odds", F.expr(odds)).where("odds > 1.59").orderBy(F.expr("odds * ln(1 + toxic)").desc(), F.col("e").desc()).limit(2 * ENTRIES)
        return lexicon_from({r["e"]: (r["clean"], r["toxic"]) for r in best.collect()}, rows)

    by_fold = [lexicon(f) for f in range(FOLDS)]

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = [Lookup(x) for x in by_fold]
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "fold": b["fold"], "x": [features(t, looks[f]) for t, f in zip(b["t"], b["fold"])]})

    got = texts.mapInPandas(tidy(featurise), "y int, fold int, x array<double>").toPandas()
    got = got.sort_values(["fold", "y", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c)  # whatever order the rows came in
    x, y, fold = np.array(got["x"].tolist()), (got["y"].to_numpy() > 0).astype(float), got["fold"].to_numpy()
    margin = np.zeros(len(y))
    for f in np.unique(fold):
        rest = fold != f
        margin[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest]) if rest.any() else 0.0
    return Model(lexicon(None), Trees().fit(x, y), isotonic(margin, y))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """The rows and their score. A column of that name that is there already is replaced."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        look = Lookup(m.lexicon)
        for b in batches:
            x = np.array([features(t or "", look) for t in b.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(x), type=pa.float64())], names=[*b.schema.names, score_col])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
