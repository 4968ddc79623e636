"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel compares words by the character triples that they hold in order, with gaps weighed down,
so stems, spaced-out and character-stuffed spellings stay near each other.  Landmarks are words of
the training sentences; projected on them the machine is linear, and its landmark weights add up to
one weight for each triple, so a word costs its own triples only.  A sentence is as toxic as its
most toxic word; of a text the few most toxic words count together, as learned, for a single word
may be like an insult by chance.  Labels are of texts, so training first
chooses each toxic text's witnesses, then fits the machine to them.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the alphabet, decay of a character's span, letters of a word that its triples start and
#: end within, and landmarks.
ALPHABET, DECAY, SPAN, LANDMARKS = 48, 0.6, 6, 192
#: Labelled texts that training looks at, at most, of either label.
TOXIC_ROWS, CLEAN_ROWS = 1200, 1500
#: Clean words nearest to the witnesses that each turn of training adds to its examples.
MINED = 1500
#: Highest words of a text that count together, and the lowest margin that counts.
TOP, LOWEST = 3, -1.5
#: Words whose scores a worker remembers; it only bounds memory.
KNOWN = 500_000
#: A word longer than this is scored in overlapping pieces of this length.
LONGEST = 24

SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?![^\W_])")


class Letters(dict):
    """Character -> code: letters by their base letter, digits, and what is left."""

    def __missing__(self, c: str) -> int:
        base = unicodedata.normalize("NFD", c)[0].lower()
        if "a" <= base <= "z":
            code = 1 + ord(base) - ord("a")
        elif base.isdecimal():
            code = 27 + int(base)
        else:
            code = 37 + ord(base) % 11
        if len(self) < 5000:
            self[c] = code
        return code


letters = Letters()


def units(text: str | None) -> list[str]:
    """Words, and runs of single characters as one word each."""
    if not text:
        return []
    text = text.lower()
    found = text.split()
    if SPACED.search(text):
        found += [re.sub(r"[ .\-_*]", "", m.group()) for m in SPACED.finditer(text)]
    return found


def pieces(word: str) -> list[str]:
    word = word.strip(".,;:!?\"'()[]{}|")
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST - 2 * SPAN
    return [word[at : at + LONGEST] for at in range(0, len(word) - LONGEST + step, step)]


def triples(length: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(length), 3) if k - i < SPAN]


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and codes of words, by length."""
    by_length = defaultdict(list)
    for at, w in enumerate(words):
        by_length[len(w)].append(at)
    for n, at in by_length.items():
        for some in range(0, len(at), 20_000):
            part = at[some : some + 20_000]
            codes = np.zeros((len(part), n + 2), np.int32)  # 0 marks both ends
            codes[:, 1:-1] = np.array([[letters[c] for c in words[i]] for i in part], np.int32).reshape(len(part), n)
            yield np.array(part), codes


def norms(codes: np.ndarray) -> np.ndarray:
    """Length of each word's image: its own triples against each other, equal ones added first."""
    n = codes.shape[1]
    plan = triples(n)
    if not plan:
        return np.ones(len(codes))
    keys = np.stack([(codes[:, i] * ALPHABET + codes[:, j]) * ALPHABET + codes[:, k] for i, j, k, _ in plan], axis=1)
    w = np.broadcast_to(np.array([x[3] for x in plan]), keys.shape)
    order = np.argsort(keys, axis=1, kind="stable")
    keys, w = np.take_along_axis(keys, order, 1), np.take_along_axis(w, order, 1)
    upto = np.cumsum(w, axis=1)
    last = np.ones(keys.shape, bool)
    last[:, :-1] = keys[:, 1:] != keys[:, :-1]
    before = np.where(last, upto, 0.0)
    start = np.maximum.accumulate(np.concatenate([np.zeros((len(keys), 1)), before[:, :-1]], axis=1), axis=1)
    return np.sqrt((np.where(last, upto - start, 0.0) ** 2).sum(axis=1))


def against(words: list[str], table: np.ndarray) -> np.ndarray:
    """Each word's normed image times a table with a row (or number) for each triple."""
    out = np.zeros((len(words), *table.shape[1:]))
    for at, codes in coded(words):
        total = np.zeros((len(at), *table.shape[1:]))
        for i, j, k, w in triples(codes.shape[1]):
            total += w * table[(codes[:, i] * ALPHABET + codes[:, j]) * ALPHABET + codes[:, k]]
        scale = norms(codes)
        out[at] = total / (scale if total.ndim == 1 else scale[:, None])
    return out


def images(words: list[str]) -> np.ndarray:
    """Column j: the normed image of words[j] over all triples."""
    table = np.zeros((ALPHABET**3, len(words)), np.float32)
    for at, codes in coded(words):
        scale = norms(codes)
        for i, j, k, w in triples(codes.shape[1]):
            np.add.at(table, ((codes[:, i] * ALPHABET + codes[:, j]) * ALPHABET + codes[:, k], at), w / scale)
    return table


class Model:
    """weights of triples and their offset; how a text's highest margins count, and the middle of
    the curve from there to scores."""

    def __init__(self, weights: np.ndarray, offset: float, share: np.ndarray | None = None, middle: float = 0.0):
        self.weights, self.offset, self.middle = weights.astype(np.float32), offset, middle
        self.share = np.eye(1, TOP)[0] if share is None else share
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.offset, self.share, self.middle

    def __setstate__(self, state):
        self.weights, self.offset, self.share, self.middle = state
        self.known = {}

    def margins(self, words: Iterable[str]) -> dict[str, float]:
        """word -> its margin, from the words remembered and, together, all others."""
        words = set(words)
        new = [w for w in words if w not in self.known]
        parts = [(w, p) for w in new for p in pieces(w)]
        got: dict[str, float] = {}
        if parts:
            for (w, _), m in zip(parts, against([p for _, p in parts], self.weights) + self.offset):
                got[w] = max(float(m), got.get(w, -9.0))
            if len(self.known) + len(got) <= KNOWN:
                self.known.update(got)
        return {w: got[w] if w in got else self.known[w] for w in words}

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The TOP highest margins of each text's words, as often as they stand there."""
        held = [units(t) for t in texts]
        at = self.margins(set().union(*held)) if held else {}
        out = np.full((len(texts), TOP), LOWEST)
        for row, words in zip(out, held):
            best = heapq.nlargest(TOP, set(words), key=lambda w: (at[w], w))
            found = [at[w] for w in best for _ in range(min(TOP, words.count(w)))][:TOP]
            row[: len(found)] = np.clip(found, LOWEST, -LOWEST)
        return out

    def text_margins(self, texts: list[str | None]) -> np.ndarray:
        return self.highest(texts) @ self.share

    def scores(self, texts: list[str | None]) -> list[float]:
        return (1 / (1 + np.exp(-4 * (self.text_margins(texts) - self.middle)))).tolist()


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 600, cost: float = 3000.0) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss, both labels weighing alike and each
    word as often as it came, by accelerated descent."""
    share = times * np.where(y > 0, 0.5 / times[y > 0].sum(), 0.5 / times[y < 0].sum())
    x1 = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.ones(x.shape[1]), 0.0) / cost
    step = 1 / (2 * np.linalg.norm(x1 * np.sqrt(share)[:, None], 2) ** 2 + 1 / cost)
    w = ahead = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        new = ahead - step * (keep * ahead - 2 * x1.T @ (share * y * slack))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def landmarks(positive: list[str], negative: list[str]) -> list[str]:
    """Words far from each other: three quarters of witnesses, a quarter of others."""
    chosen: list[str] = []
    for words, n in ((positive, LANDMARKS * 3 // 4), (negative, LANDMARKS // 4)):
        seen = Counter(words)
        words = sorted(seen, key=lambda w: (-seen[w], w))
        words = words[:100] + words[100 :: max(1, len(words) // 500)]
        if not words:
            continue
        own = words[:1]
        near = np.full(len(words), -1.0)
        while len(own) < min(n, len(words)):
            near = np.maximum(near, against(words, images([own[-1]]))[:, 0])
            own.append(words[int(near.argmin())])
        chosen += own
    return chosen


def first_witnesses(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Each toxic text's words with character runs that many toxic and hardly any clean texts hold;
    where no text has such a word, each text's word with the best run."""

    def runs(word: str) -> set[str]:
        w = word.strip(".,;:!?\"'()[]{}|")
        return {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)} or {w}

    in_toxic, in_clean = Counter(), Counter()
    for texts, count in ((toxic, in_toxic), (clean, in_clean)):
        for t in texts:
            count.update(set().union(*map(runs, t)) if t else ())
    scale = max(len(toxic), 1) / max(len(clean), 1)

    least = max(3, len(toxic) // 150)

    def gain(run: str) -> float:
        p, n = in_toxic[run], in_clean[run] * scale
        return p * np.log((p + 0.5) / (n + 0.5)) * (1 if p >= least and p > 3 * n else 1e-3) if p > n else 0.0

    known: dict[str, float] = {}

    def score(word: str) -> float:
        if word not in known:
            known[word] = max(map(gain, runs(word)))
        return known[word]

    strong = max(15.0, least * np.log(10))
    sure = [w for t in toxic for w in sorted(t) if score(w) >= strong]
    return sure or [max(t, key=lambda w: (score(w), w)) for t in toxic]


def train(texts: list[str], labels: list[int], rounds: int = 4) -> Model:
    """Fits the machine to witnesses against clean words, again and again with the clean words that
    it takes for witnesses; then weighs a text's highest words and places the curve between the labels."""
    held = [set(units(t)) for t in texts]
    toxic = [h for h, y in zip(held, labels) if y and h]
    clean = [h for h, y in zip(held, labels) if not y and h]
    if not toxic or not clean:
        return Model(np.zeros(ALPHABET**3), -1.0)
    trim = lambda ws: [p for w in ws for p in pieces(w) if len(p) >= 2]
    in_toxic, in_clean = Counter(w for t in toxic for w in t), Counter(w for t in clean for w in t)
    usual = lambda w: 3 * in_clean[w] * len(toxic) >= in_toxic[w] * len(clean)
    witnesses = [w for w in first_witnesses(toxic, clean) if not usual(w)]
    if not witnesses:
        return Model(np.zeros(ALPHABET**3), -1.0)
    positive = trim(witnesses)
    rest = sorted(in_clean)
    rng = np.random.default_rng(5)
    negative = trim(rng.choice(rest, min(len(rest), 3000), replace=False).tolist()) + trim(w for w, _ in in_clean.most_common(300))
    for _ in range(rounds):
        marks = landmarks(positive, negative)
        table = images(marks)
        values, vectors = np.linalg.eigh(against(marks, table))
        values = np.maximum(values, 1e-6)
        root = vectors / np.sqrt(values) @ vectors.T
        came = Counter(positive)
        x = against([*came, *negative], table) @ root
        w, offset = fit(x, np.array([1.0] * len(came) + [-1.0] * len(negative)), np.array([*came.values()] + [1] * len(negative), float))
        model = Model(table @ (root @ w), offset)
        at = model.margins(rest)
        hard = sorted(rest, key=lambda u: (-at[u], u))
        negative = sorted(set(negative) | set(trim(hard[:MINED])))
        rest = hard[: 20 * MINED]  # later turns look for hard words among these
    model.known = {}
    top, y = model.highest(texts), np.array(labels, bool)
    weights, _ = fit(top, np.where(y, 1.0, -1.0), np.ones(len(y)))
    weights = np.maximum(weights, 0)
    model.share = weights / weights.sum() if weights.sum() > 0 else model.share
    margins = model.text_margins(texts)
    cuts = np.unique(margins)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    right = [(margins[y] > c).mean() + (margins[~y] <= c).mean() for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    model.middle = float(cuts[best[len(best) // 2]])
    model.known = {}
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on at most TOXIC_ROWS and CLEAN_ROWS labelled texts that are not held out, those with
    the lowest hashes of doc_id; label rows without doc_id or label do not count."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    side = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = side(1, TOXIC_ROWS).union(side(0, CLEAN_ROWS))
    # A document of several rows has one text here, the first in order; so the rows that come are bounded.
    held = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = held.orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher where the label is likelier; null and empty texts have a low score."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            some = some.tolist()
            yield pd.Series([s for at in range(0, len(some), 512) for s in model.scores([t if isinstance(t, str) else None for t in some[at : at + 512]])], dtype="float64")

    return run(text)


def toxicity_report(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; repeated rows get equal scores."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
