"""Toxicity: a counterfactually regularised linear classifier.

Features of a text are its distinct lower-case words and their first characters.
Training minimises logistic loss, plus a penalty on how far the score of a sentence
of a labelled text moves when its identity terms are swapped for the next and for
the one before in their groups, all at once, so that neutral mentions of a group
don't count as toxic. Terms that are other words as well (black, old, straight) are
swapped only in sentences that mention people. Labels are a bounded, hash-ordered
sample; scoring is a narrow map over all whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, bound_batches, checkpointed, fresh, release, slices

#: Labelled rows that training uses at most (those with the smallest hash of their id).
MAX_LABELLED = 20_000
#: Features are those whose log odds are at least so many standard errors from 0, and identity terms; there is no limit to their number but the labelled texts.
EVIDENCE = 2.5
PREFIX = 5

#: Interchangeable group mentions; texts with one are also seen with another of its row.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "native"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
)

#: Terms that name a group only beside a word for people.
AMBIGUOUS = frozenset(b"black white native straight blind deaf old young".split())
PEOPLE = frozenset(
    b"people person persons man men woman women boy boys girl girls child children kid kids family families friend friends neighbour neighbours neighbor neighbors community communities "
    b"folk folks guy guys worker workers student students teacher teachers couple couples he she they who american americans african africans european europeans".split()
)
_SENTENCE = re.compile(r"[.!?\n]+")

_BLANK = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()) if text else set()


def features(words: set[bytes]) -> set[bytes]:
    """Words, and marked prefixes of the longer ones."""
    return words | {b"^" + w[:PREFIX] for w in words if len(w) >= PREFIX}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[bytes, float]

    def logit(self, text: str | None) -> float:
        get = self.weights.get
        # sums in a fixed order, so that a score is the same wherever it is made
        return self.bias + math.fsum(get(f, 0.0) for f in features(tokens(text)))

    def score(self, text: str | None) -> float:
        x = max(-40.0, min(40.0, self.logit(text)))
        return 1 / (1 + math.exp(-x))


def swaps(words: set[bytes], groups=IDENTITY_GROUPS) -> list[set[bytes]]:
    """The words with each identity term swapped for the next of its group, and for the one before; nothing without any.

    All terms are swapped at once, so that none is swapped twice. Two variants that are
    the same set are one, and a set that stays as it is is none.
    """
    people = bool(words & PEOPLE)
    out = []
    for step in (1, -1):
        to = {}
        for group in groups:
            terms = [g.encode() for g in group]
            for i, t in enumerate(terms):
                if t in words and (people or t not in AMBIGUOUS):
                    to[t] = terms[(i + step) % len(terms)]
        made = {to.get(w, w) for w in words}
        if made != words and made not in out:
            out.append(made)
    return out


def fit(rows: list[tuple[int, list[int]]], pairs: list[tuple[list[int], list[int]]], strength: np.ndarray, *, l2: float = 1e-3, counterfactual: float = 1.0, steps: int = 300, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Bias and weights for `rows` (label, feature numbers).

    `strength` scales each feature (its log odds). pairs holds the features that a
    swap takes away and adds; the squared change of the logit is penalised.
    """
    n_f = len(strength)
    y = np.array([r[0] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([f for r in rows for f in r[1]], np.int64)
    x = strength[col] if len(col) else np.zeros(0)
    p_at = np.array([i for i, (a, b) in enumerate(pairs) for _ in range(len(a) + len(b))], np.int64)
    p_col = np.array([f for a, b in pairs for f in (*a, *b)], np.int64)
    p_x = np.array([s for a, b in pairs for s in ([-1.0] * len(a) + [1.0] * len(b))]) * (np.abs(strength[p_col]) if len(p_col) else 1)
    w, bias = np.full(n_f, 0.5), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m = np.zeros(n_f + 1)
    v = np.zeros(n_f + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, x * w[col], len(rows)) + bias if len(col) else np.full(len(rows), bias)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / max(1, len(rows))
        grad = np.bincount(col, err[at] * x, n_f) if len(col) else np.zeros(n_f)
        if len(p_col):
            # the sign of a feature's strength belongs to its weight here
            signed = np.sign(strength[p_col])
            d = np.bincount(p_at, p_x * signed * w[p_col], len(pairs))
            grad += counterfactual * 2 / len(pairs) * np.bincount(p_col, d[p_at] * p_x * signed, n_f)
        grad += l2 * w / max(1, n_f)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return bias, w * strength


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, groups=IDENTITY_GROUPS, counterfactual: float = 1.0, keep=None) -> Model:
    """Fit on labelled rows whose crc32 of the id (as text) mod 5 is not 0, `max_labelled` at most.

    `keep` may be another condition on the label rows' id column. Rows without id or label are
    left out; a document or label that is there repeatedly counts as often; null and empty
    texts are rows without features. Of rows that tie for the last place of the sample the
    one labelled 0 is taken. Without labelled rows the model scores every text 0.5 less a hair.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    usable = usable.where(F.crc32(F.col("id").cast("string")) % 5 != 0) if keep is None else usable.where(keep(F.col("id")))
    chosen = usable.orderBy(F.xxhash64("id"), "y").limit(max_labelled)
    # bounded by max_labelled rows of two numbers
    told = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y"))

    def words(batches):
        for batch in batches:
            for part in slices(batch, 0):
                sets = [[*features(tokens(t))] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.binary())), part.column(1)], names=["f", "y"])

    exploded = told.mapInArrow(words, "f array<binary>, y int").select(F.explode("f").alias("f"), "y")
    size = told.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = size["n"], size["pos"]
    if not n or not pos or n == pos:
        release(told)
        return Model(5.0 if n and n == pos else -5.0 if n else -1e-6, {})
    a, b = F.col("a"), F.col("n") - F.col("a")
    ratio = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (n - pos + 1))
    counted = exploded.groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    evidence = F.abs(ratio) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    # bounded by the texts of max_labelled rows
    strong = counted.select("f", ratio.alias("r"), evidence.alias("z")).where(F.col("z") > EVIDENCE).orderBy(F.desc("z"), "f").collect()
    names = [bytes(r["f"]) for r in strong]
    have = set(names)
    named = features({g.encode() for group in groups for g in group})
    names += sorted(named - have)
    # a neutral strength for identity terms that the labels say little about
    strength = np.array([r["r"] for r in strong] + [0.1] * (len(names) - len(strong)))
    terms = {g.encode() for group in groups for g in group}
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbers(batches):
        get = number.value.get
        of = lambda ws: sorted(i for i in map(get, features(ws)) if i is not None)
        for batch in batches:
            for part in slices(batch, 0):
                fs, minus, plus = [], [], []
                for t in part.column(0).to_pylist():
                    fs.append(of(tokens(t)))
                    less, more = [], []
                    for sentence in _SENTENCE.split(t or ""):
                        ws = tokens(sentence)
                        if not ws.isdisjoint(terms):
                            f = {*of(ws)}
                            for other in swaps(ws, groups):
                                g = {*of(other)}
                                if f != g:
                                    less.append(sorted(f - g))
                                    more.append(sorted(g - f))
                    minus.append(less)
                    plus.append(more)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(fs, kind), pa.array(minus, pa.list_(kind)), pa.array(plus, pa.list_(kind))], names=["y", "f", "minus", "plus"])

    seen = told.mapInArrow(numbers, "y int, f array<int>, minus array<array<int>>, plus array<array<int>>").toArrow().to_pylist()
    release(told)
    seen.sort(key=lambda r: (r["y"], r["f"], r["minus"], r["plus"]))
    pairs = [p for r in seen for p in zip(r["minus"], r["plus"])]
    bias, w = fit([(r["y"], r["f"]) for r in seen], pairs, strength, counterfactual=counterfactual)
    return Model(bias, {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4})


def add_score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """`docs` with a struct column `name`: score (0 to 1) and predicted (1 from 0.5 up).

    A null text counts as empty and gets the bias alone; a text of any length is read whole.
    Repeated rows are rows each, an empty table gives none. Other columns pass through, and
    a column of that name gets company with underscores in front.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled texts
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        score = shared.value.score

        def one(column):
            s = [score(t) for t in column.to_pylist()]
            return pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["score", "predicted"])

        return one

    return annotate(docs, text_col, make, kind, fresh(docs, name))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
