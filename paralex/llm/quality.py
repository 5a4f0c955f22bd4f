"""Operator 6: quality classifier over random-indexing word vectors.

Every word has a sparse random index vector, a function of its hash.  Words that
occur often in the learning sample get a context vector instead: the sum of the
index vectors around them.  The same is done for the shapes of words (letters
folded to case, digits to 9, other characters kept).  A document is the mean of
its words' vectors next to the mean of its shapes', with a few rates; a network
of two layers, in numpy, gives a logit, and one temperature, fitted on a part
held back, makes it a probability.  Words of over ``LONG_WORD`` characters are cut
into pieces of that length, every one of which counts.

Learning takes passages of up to ``PASSAGE`` characters, so that long texts can be learned
from and none outweighs the others: ``PER_TEXT`` of a text at most (in expectation), about
``LEARN_ROWS`` of all, fewer where they would hold more than ``LEARN_TOTAL`` bytes, but
``LEAST_OF_CLASS`` of each class (or all), which then weigh less each.  They are drawn by a
hash of id, text and place, with shares that follow from all different labelled texts that
aren't held out, so the sample is the same however rows are ordered, dealt or repeated.  Any
sample of both classes is learned from, however small.  One task learns, part by part, and
only the finished model (bounded by ``MOST_WORDS``) reaches the driver.  Scoring takes all
documents and whole texts.

Defined results: texts without words score the share of good ones among the
learned; an id labelled more than once has its mean label; without labels the
score is 0.5, with one class only it is that class; repeated rows repeat; other
columns are not read, or pass through unchanged whatever their names.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import apart, from_text, map_batches, quoted, small_batches, unused
from paralex.llm.folds import held_out, sampled

LEARN_ROWS, LEARN_TOTAL = 6_000, 32 << 20
PASSAGE, PER_TEXT, LEAST_OF_CLASS = 8_192, 8, 200
#: Most ids of a class that are sent to the texts.
NEAR_IDS = 100_000
#: Passages that the temperature is fitted on at least; with fewer it is one.
LEAST_BACK = 20
DIMS, NONZERO, BUCKETS = 48, 6, 4_096
WINDOW, LEAST_COUNT, MOST_WORDS = 2, 5, 20_000
HIDDEN, EPOCHS, SEED = 24, 250, 6
RATES = 4
#: Standard deviations that an input may be off.
FAR = 8.0
#: A document counts as good from this probability on.
CUT = 0.3
LONG_WORD = 64
#: Characters of a text that are handled at a time.
PART = 1 << 16
_CASE = {i: ("A" if chr(i).isupper() else "a" if chr(i).isalpha() else "9" if chr(i).isdigit() else chr(i)) for i in range(0x250)}


_SPACE = re.compile(r"\s")


def shape(word: str) -> str:
    """Folded characters, each run of one kept once: ``Word,`` is ``Aa,``."""
    out, last = [], ""
    for c in word.translate(_CASE):
        if c != last:
            out.append(c)
            last = c
    return "".join(out)


def words_of(text: str | None) -> Iterator[list[str]]:
    """All words of a text, in lists of bounded length.

    Parts end at white space, but for text without any, where they end anywhere.
    """
    text = text or ""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            gap = _SPACE.search(text, end, end + PART)
            end = gap.start() if gap else end + PART
        found = text[at:end].split()
        if max(map(len, found), default=0) > LONG_WORD:
            found = [w[i : i + LONG_WORD] for w in found for i in range(0, len(w), LONG_WORD)]
        if found:
            yield found
        at = end


@functools.cache
def index_vectors() -> np.ndarray:
    """One sparse ternary vector a bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for row in out:
        at = rng.choice(DIMS, NONZERO, replace=False)
        row[at] = np.tile([1, -1], NONZERO // 2)
    return out


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), SEED) % BUCKETS


class WordSpace:
    """Vectors of words and shapes: buckets first, learned ones after them."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.word_vectors = self.shape_vectors = index_vectors()

    @staticmethod
    def _learn(texts: list[str], cut) -> tuple[dict[str, int], np.ndarray]:
        """Places and vectors of the tokens that ``cut`` makes of words; one part's tokens are held at a time."""
        counts: Counter[str] = Counter()
        for text in texts:
            for words in words_of(text):
                counts.update(cut(words))
        kept = sorted((t for t, n in counts.items() if n >= LEAST_COUNT), key=lambda t: (-counts[t], t))[:MOST_WORDS]
        place = {t: i for i, t in enumerate(kept)}
        del counts
        base = index_vectors()
        spot = {t: bucket(t) for t in kept}
        context = np.zeros((len(kept), DIMS), np.float32)
        for text in texts:
            for words in words_of(text):
                tokens = cut(words)
                own = np.array([place.get(t, -1) for t in tokens])
                near = base[[spot[t] if t in spot else bucket(t) for t in tokens]]
                around = np.zeros_like(near)
                for step in range(1, WINDOW + 1):
                    around[step:] += near[:-step]
                    around[:-step] += near[step:]
                known = own >= 0
                np.add.at(context, own[known], around[known])
        size = np.sqrt((context**2).sum(axis=1, keepdims=True))
        context *= np.sqrt(NONZERO) / np.maximum(size, 1e-6)
        return {t: BUCKETS + i for t, i in place.items()}, np.vstack([base, context])

    def learn(self, texts: list[str]) -> None:
        self.words, self.word_vectors = self._learn(texts, lambda words: [w.lower() for w in words])
        folded = functools.lru_cache(1 << 16)(shape)
        self.shapes, self.shape_vectors = self._learn(texts, lambda words: [folded(w) for w in words])


class Pooler:
    """Document vectors of one worker; remembers where words have their vectors."""

    LIMIT = 200_000

    def __init__(self, space: WordSpace):
        self.space = space
        self.known: dict[str, int] = {}

    def _find(self, word: str) -> int:
        low, form = word.lower(), shape(word)
        i, j = self.space.words.get(low), self.space.shapes.get(form)
        place = (bucket(low) if i is None else i) << 32 | (bucket(form) if j is None else j)
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        self.known[word] = place
        return place

    def vector(self, text: str | None) -> np.ndarray:
        out = np.zeros(2 * DIMS + RATES, np.float64)
        known, find = self.known, self._find
        n = same = 0
        last = -1
        for words in words_of(text):
            both = np.array([known.get(w) or find(w) for w in words], np.int64)
            for at in range(0, len(both), 16_384):
                part = both[at : at + 16_384]
                out[:DIMS] += self.space.word_vectors[part >> 32].sum(axis=0)
                out[DIMS : 2 * DIMS] += self.space.shape_vectors[part & 0xFFFFFFFF].sum(axis=0)
            same += int((both[1:] == both[:-1]).sum()) + int(both[0] == last)
            n, last = n + len(both), int(both[-1])
        if not n:
            out[-1] = 1
            return out
        out /= n
        out[-4] = same / (n - 1) if n > 1 else 0
        out[-3] = np.log1p(n) / 10
        out[-2] = len(text) / n / 20
        return out


class Network:
    """inputs -> tanh -> logit / temperature."""

    def __init__(self, inputs: np.ndarray, labels: np.ndarray, back: np.ndarray, weights: np.ndarray):
        x, y, weight = inputs[~back], labels[~back], weights[~back] / weights[~back].sum()
        self.share = float(np.average(labels, weights=weights))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self._scaled(x)
        rng = np.random.default_rng(SEED)
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(x @ self.w[0] + self.w[1])
            z = h @ self.w[2] + self.w[3]
            d = (1 / (1 + np.exp(-z)) - y) * weight
            dh = np.outer(d, self.w[2]) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):  # Adam
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if back.sum() >= LEAST_BACK:
            z, y = self.logits(inputs[back]), labels[back]
            trial = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.average(np.logaddexp(0, np.where(y > 0.5, -z, z) / t), weights=weights[back]) for t in trial]
            self.temperature = float(trial[int(np.argmin(loss))])

    def _scaled(self, inputs: np.ndarray) -> np.ndarray:
        return np.clip((inputs - self.mean) / self.scale, -FAR, FAR)

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(inputs) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        out = 1 / (1 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -60, 60)))
        return np.where(inputs[:, -1] > 0, self.share, out)  # no words: nothing but the share of good ones


def fit(texts: list[str], good: list[bool], weights: list[float] | None = None) -> tuple[WordSpace, Network] | float:
    """The word space and network, or a constant score if there is nothing to tell apart."""
    y = np.array(good, np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    space = WordSpace()
    space.learn(texts)
    pool = Pooler(space)
    x = np.array([pool.vector(t) for t in texts])
    back = np.random.default_rng(SEED).random(len(y)) < 0.2
    if back.sum() < LEAST_BACK or not 0 < y[~back].mean() < 1:
        back[:] = False
    return space, Network(x, y, back, np.ones(len(y)) if weights is None else np.array(weights))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, good, weight`` of the passages to learn from, each once."""
    usable = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    rated = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    own = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    passages = F.greatest(F.lit(1), F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / PASSAGE)).cast("int")
    part = F.least(F.lit(1.0), PER_TEXT / F.col("passages"))
    # Texts are known by a hash here, so that narrow rows move.
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    each = own.select("doc_id", F.xxhash64("text").alias("mark"), passages.alias("passages"), size).distinct().join(rated, "doc_id")
    sums = each.groupBy("good").agg(F.sum(F.col("passages") * part).alias("n"), F.sum(F.col("size") * part).alias("size"), F.count_distinct("doc_id").alias("ids")).collect()
    n, total = (max(1.0, float(sum(r[c] for r in sums))) for c in ("n", "size"))
    share = min(1.0, LEARN_ROWS / n, LEARN_TOTAL / total)
    place = lambda j: F.struct(F.col("doc_id"), F.xxhash64("text").alias("t"), j.alias("j"))
    found = []
    for r in sums:
        mine = min(1.0, max(share, LEAST_OF_CLASS / float(r["n"])))
        of_class, own_rows = rated.filter(F.col("good") == r["good"]), own.withColumn("passages", passages)
        drawn = F.filter(F.sequence(F.lit(0), F.col("passages") - 1), lambda j: sampled(place(j), part * mine, SEED))  # noqa: B023
        # Texts don't move: few ids are sent to them, and of many ids' texts few are drawn.
        if r["ids"] <= NEAR_IDS:
            of_class = F.broadcast(of_class)
        rows = own_rows.withColumn("drawn", drawn).filter(F.size("drawn") > 0).join(of_class, "doc_id")
        rows = rows.select("doc_id", "text", "good", F.lit(share / mine).alias("weight"), F.explode("drawn").alias("j"))
        found.append(rows.withColumn("text", F.substring("text", F.col("j") * PASSAGE + 1, F.lit(PASSAGE))))
    none = own.select("doc_id", "text", F.lit(True).alias("good"), F.lit(1.0).alias("weight"), F.lit(0).alias("j")).limit(0)
    return reduce(DataFrame.unionByName, found or [none]).distinct().drop("j")


def learn(docs: DataFrame, labels: DataFrame):
    """What ``fit`` makes of the sample; one task reads it, in an order that only its rows decide."""
    drawn = sample(docs, labels).repartition(1).sortWithinPartitions("doc_id", "text")

    def work(batches):
        texts, good, weights = [], [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            good += batch.column("good").to_pylist()
            weights += batch.column("weight").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([apart(lambda: pickle.dumps(fit(texts, good, weights)))], pa.binary())], names=["model"])

    with small_batches(docs.sparkSession):
        made = map_batches(drawn.select("text", "good", "weight"), work, "model binary").collect()  # one row
    return pickle.loads(made[0]["model"]) if made else 0.5


def scored(docs: DataFrame, model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score, in a column that is called ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_WORDS

    def work(lists):
        model = shared.value
        pool = Pooler(model[0]) if isinstance(model, tuple) else None
        for texts in lists:
            if pool is None:
                values = np.full(len(texts), model)
            else:
                values = model[1].scores(np.array([pool.vector(t) for t in texts]))
            yield pa.array(values, pa.float64())

    return from_text(docs, name, work, "double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with the same columns."""
    (score,) = unused(docs.columns, "quality_score")
    out = scored(docs, learn(docs, labels), score)
    return out.filter(F.col(score) >= CUT).select(*map(quoted, docs.columns))
