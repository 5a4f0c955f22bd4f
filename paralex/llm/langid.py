"""Operator 7: language identification by error-correcting output codes.

Each learned language has a codeword; for every bit a binary classifier over
hashed byte n-grams (orders 1 to 4) sums log-ratios of smoothed frequencies over
the whole text.  Decoding weighs each bit's logistic loss by how well its
classifier did on a part held back and takes the codeword of least loss; a
softmax over losses is the score.  Where the second best codeword is nearly as
likely (the odds of the best against it are under ``CLEAR``), the result is marked
ambiguous.

Up to seven languages use exhaustive codes, more use random codes chosen for
their distance.  Learning takes about ``LEARN_ROWS`` different passages of at most
``PASSAGE`` characters, equal shares of each language and ``LEAST`` of each at
least, never of the held-out fold.  A document is as many passages as its length
asks for and each is drawn by a hash of id, text and place, so that long documents
are learned from like short ones.  One task counts their n-grams; only the finished
model reaches the driver.

Defined results: texts that are null or have no letter are ``und`` with score 0;
with no language to learn all are ``und``; repeated rows repeat; other columns
are not read, or pass through unchanged whatever their names.
"""

from __future__ import annotations

import pickle
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paralex.llm.common import apart, from_text, map_batches, quoted, small_batches, unused
from paralex.llm.folds import held_out, sampled

LEARN_ROWS, LEAST, PASSAGE, SEED = 3_000, 20, 1 << 13, 7
ORDERS, BITS = (1, 2, 3, 4), 15
SMOOTH, SHARPNESS = 0.5, 0.25
PART = 1 << 17
UNKNOWN = "und"
#: Odds of the best codeword against the second best, below which they are too close to tell.
CLEAR = 1.5
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def grams(data: bytes):
    """Yield arrays of feature numbers; parts overlap so that no n-gram is lost."""
    most = max(ORDERS)
    for at in range(0, len(data), PART):
        points = _FOLD[np.frombuffer(data, np.uint8, min(len(data) - at, PART + most - 1), at)].astype(np.uint32)
        own = min(PART, len(data) - at)
        value = points
        for n in range(1, most + 1):
            if n > 1:
                value = (value[:-1] << np.uint32(8)) | points[n - 1 :] if n <= 4 else value
            if n in ORDERS:
                hashed = (value[:own] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
                yield hashed


def features(text: str) -> np.ndarray:
    """Counts of all hashed n-grams of a whole text."""
    out = np.zeros(1 << BITS)
    for part in grams(f" {text} ".encode()):
        out += np.bincount(part, minlength=1 << BITS)
    return out


def codebook(count: int) -> np.ndarray:
    """Rows of +1 and -1, one a language."""
    if count <= 1:
        return np.ones((count, 1))
    if count <= 7:
        columns = [c for c in product((1, -1), repeat=count) if c[0] == 1 and -1 in c]
        return np.array(columns).T
    rng = np.random.default_rng(SEED)
    width = int(np.ceil(12 * np.log2(count)))
    best, least = None, -1
    for _ in range(50):
        trial = rng.choice((-1, 1), (count, width))
        apart = (width - trial @ trial.T) / 2 + np.eye(count) * width
        mixed = (abs(trial.sum(axis=0)) < count).all()
        if mixed and apart.min() > least:
            best, least = trial, apart.min()
    return best if best is not None else trial


class LanguageModel:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.code = codebook(len(self.langs))
        place = {v: i for i, v in enumerate(self.langs)}
        own = np.array([place[v] for v in langs])
        back = np.random.default_rng(SEED).random(len(own)) < 0.15
        if len(set(own[~back].tolist())) < len(self.langs):
            back[:] = False
        counts = np.zeros((len(self.langs), 1 << BITS))
        for text, lang, skip in zip(texts, own, back):
            if not skip:
                counts[lang] += features(text)
        rates = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))  # each language weighs the same
        self.weights = np.zeros((1 << BITS, self.code.shape[1]), np.float32)
        floor = SMOOTH / max(1.0, counts.sum() / max(1, len(self.langs)))
        for j in range(self.code.shape[1]):
            yes, no = self.code[:, j] > 0, self.code[:, j] < 0
            if yes.any() and no.any():
                self.weights[:, j] = np.log(rates[yes].mean(axis=0) + floor) - np.log(rates[no].mean(axis=0) + floor)
        self.trust = np.ones(self.code.shape[1])
        if back.any():
            margins = np.array([self.margins(t) for t, skip in zip(texts, back) if skip])
            right = (np.sign(margins) == self.code[own[back]]).mean(axis=0)
            odds = np.clip(right, 0.5, 0.999)
            self.trust = np.log(odds / (1 - odds)) + 1e-3
            self.trust *= len(self.trust) / self.trust.sum()

    def margins(self, text: str) -> np.ndarray:
        """Sum of log-ratios of each bit over the whole text."""
        out = np.zeros(self.weights.shape[1])
        for part in grams(f" {text} ".encode()):
            out += self.weights[part].sum(axis=0, dtype=np.float64)
        return out

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score, and whether the second best is too near."""
        loss = (self.trust * np.logaddexp(0, -SHARPNESS * self.code * margins)).sum(axis=1)
        weight = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        second = np.delete(weight, best).max(initial=0.0)
        return self.langs[best], float(weight[best] / weight.sum()), bool(CLEAR * second > weight[best])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text):
            return UNKNOWN, 0.0, True
        return self.decode(self.margins(text))


def sample(docs: DataFrame) -> DataFrame:
    """``text, lang`` of the passages to learn from, each once."""
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"))
    )
    usable = usable.withColumn("mark", F.xxhash64("text")).withColumn("parts", F.ceil(F.length("text") / F.lit(PASSAGE)).cast("int"))
    # Counted once each, known by a hash, so that narrow rows move.
    each = usable.select("doc_id", "mark", "parts", "lang").distinct()
    counts = {r[0]: r[1] for r in each.groupBy("lang").agg(F.sum("parts")).collect()}  # one row a language
    if not counts:
        return usable.limit(0).select("doc_id", F.lit(0).alias("part"), "lang", "text")
    most = max(LEAST, LEARN_ROWS // len(counts))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    drawn = F.lit(False)
    for lang, n in sorted(counts.items()):
        drawn = drawn | ((F.col("lang") == lang) & sampled(F.struct("doc_id", "mark", "part"), most / n, SEED))
    parts = usable.select("doc_id", "mark", "lang", "text", part).filter(drawn)
    passages = parts.select("doc_id", "part", "lang", F.substring("text", F.col("part") * PASSAGE + 1, F.lit(PASSAGE)).alias("text"))
    return passages.distinct()


def learn(docs: DataFrame) -> LanguageModel | None:
    """The model of the sample; one task reads it, in an order that only its rows decide."""
    drawn = sample(docs).repartition(1).sortWithinPartitions("doc_id", "part", "lang", "text")

    def work(batches):
        texts, langs = [], []
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    texts.append(text)
                    langs.append(lang)
        made = apart(lambda: pickle.dumps(LanguageModel(texts, langs) if texts else None))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    with small_batches(docs.sparkSession):
        made = map_batches(drawn.select("text", "lang"), work, "model binary").collect()  # one row
    return pickle.loads(made[0]["model"]) if made else None


def predicted(docs: DataFrame, model: LanguageModel | None, name: str = "found") -> DataFrame:
    """``docs`` with a struct ``name`` of ``lang, score, ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a bit

    def work(lists):
        model = shared.value
        for texts in lists:
            found = [model.predict(t) if model else (UNKNOWN, 0.0, True) for t in texts]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(made, names=["lang", "score", "ambiguous"])

    return from_text(docs, name, work, "lang string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every document."""
    out = predicted(docs.select("doc_id", "text"), learn(docs))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.ambiguous").alias("ambiguous"),
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told without ambiguity, with the same columns."""
    (found,) = unused(docs.columns, "found")
    out = predicted(docs, learn(docs), found)
    return out.filter((F.col(f"{found}.lang") != UNKNOWN) & ~F.col(f"{found}.ambiguous")).select(*map(quoted, docs.columns))
