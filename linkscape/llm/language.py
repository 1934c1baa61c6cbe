"""Language identification by unigram pieces, with all segmentations of a word summed.

Each language has a distribution over the pieces of one fixed public vocabulary.  A word's
probability is the sum, over all ways to cut it into pieces, of the products of their
probabilities: the forward algorithm.  Training is expectation maximisation on word counts, run as Spark jobs (forward and
backward sums a word, expected piece counts summed by language and piece).  A text's score is its words' log
probabilities summed; ``score`` is the posterior of the predicted language under equal priors.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscape.llm.common import cut, table

#: Probability kept for a character that no piece covers, and weight of the uniform share of every piece.
FLOOR = 1e-7
SMOOTH = 0.5
#: Sums over words of so many characters stay far above the least double (FLOOR ** 40 is 1e-280); longer ones are scaled on the way, or summed in logs.
PLAIN = 40
#: Characters after which a long word's sums are scaled again.
STRIDE = 16
#: Words remembered in a task, and texts whose words are learned together.
MEMO_WORDS = 100_000
PART = 64
#: Words: runs of letters and marks, lower case.
WORD = re.compile(r"[^\W\d_]+")


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters alone, lower case, each once, in order; U+2581 (word start) is dropped."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in found if p.isalpha()]


def split_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Model:
    """Piece probabilities: ``table`` maps a piece to one probability a language, in the order of ``languages``."""

    def __init__(self, languages: list[str], table: dict[str, tuple[float, ...]]):
        self.languages, self.table = languages, table
        self.longest = max(map(len, table), default=1)

    def cuts(self, word: str) -> list[list[tuple[int, str]]]:
        """For each end, the pieces that end there, with their starts."""
        return [[(i, word[i:j]) for i in range(max(0, j - self.longest), j) if word[i:j] in self.table] for j in range(1, len(word) + 1)]


class Scorer:
    """The forward algorithm for many words at once, with the words seen so far remembered as rows of a matrix."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.place = {p: k for k, p in enumerate(model.table, 1)}
        self.table = np.zeros((len(model.table) + 1, len(model.languages)))  # row 0: no piece
        for p, k in self.place.items():
            self.table[k] = model.table[p]
        self.logs = np.zeros((0, len(model.languages)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (all of one length, PLAIN at most), a column a language: the sum over all segmentations."""
        n, longest, get = len(words[0]), self.model.longest, self.place.get
        alpha = [np.ones((len(words), len(self.model.languages)))]
        for j in range(1, n + 1):
            total = alpha[j - 1] * FLOOR
            for i in range(max(0, j - longest), j):
                total += alpha[i] * self.table[[get(w[i:j], 0) for w in words]]
            alpha.append(total)
        return np.log(alpha[n])

    def forward_long(self, word: str) -> np.ndarray:
        """The same for one word of any length: the last sums are kept, divided by the latest of them every STRIDE characters, and the logs of the divisors add up."""
        longest, get = self.model.longest, self.place.get
        width = len(self.model.languages)
        scale, last = np.zeros(width), deque([np.ones(width)], maxlen=longest)
        for j in range(1, len(word) + 1):
            total = last[-1] * FLOOR
            for back in range(1, len(last) + 1):
                row = get(word[j - back : j])
                if row is not None:
                    total = total + last[-back] * self.table[row]
            last.append(total)
            if j % STRIDE == 0:
                scale += np.log(total)
                last = deque([x / total for x in last], maxlen=longest)
        return scale + np.log(last[-1])

    def learn(self, words: list[str]) -> None:
        """Remember these words, but for long ones."""
        short = {w for w in words if len(w) <= PLAIN}
        new = sorted({w for w in short if w not in self.rows}, key=lambda w: (len(w), w))
        if len(self.rows) + len(new) > MEMO_WORDS:
            self.rows, self.logs, new = {}, self.logs[:0], sorted(short, key=lambda w: (len(w), w))
        found = [self.forward(list(g)) for _, g in itertools.groupby(new, key=len)]
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.logs = np.concatenate([self.logs, *found])

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the words' log probabilities, a value a language."""
        rows = self.rows
        known = self.logs[[rows[w] for w in words if len(w) <= PLAIN]].sum(axis=0)
        return sum((self.forward_long(w) for w in words if len(w) > PLAIN), known)


def _log_sum(logs: list[float]) -> float:
    most = max(logs)
    return most + math.log(sum(math.exp(x - most) for x in logs))


def _shares(ends: list[list[tuple[int, str]]], table: dict[str, tuple[float, ...]], k: int) -> list[tuple[str, float]]:
    """Expected count of each piece at each of its places in one word, for language k."""
    n = len(ends)
    if n > PLAIN:
        logs = [[(i, p, math.log(table[p][k])) for i, p in found if table[p][k] > 0] for found in ends]
        alpha = [0.0]
        for j, found in enumerate(logs, 1):
            alpha.append(_log_sum([alpha[j - 1] + math.log(FLOOR), *[alpha[i] + q for i, _, q in found]]))
        onward: list[list[float]] = [[] for _ in range(n)]
        beta = [0.0] * (n + 1)
        for j in range(n, 0, -1):
            if j < n:
                beta[j] = _log_sum(onward[j])
            onward[j - 1].append(beta[j] + math.log(FLOOR))
            for i, _, q in logs[j - 1]:
                onward[i].append(beta[j] + q)
        return [(p, math.exp(alpha[i] + q + beta[j] - alpha[n])) for j, found in enumerate(logs, 1) for i, p, q in found]
    alpha = [1.0]
    for j, found in enumerate(ends, 1):
        alpha.append(alpha[j - 1] * FLOOR + sum(alpha[i] * table[p][k] for i, p in found))
    beta = [0.0] * n + [1.0]
    for j in range(n, 0, -1):
        beta[j - 1] += beta[j] * FLOOR
        for i, p in ends[j - 1]:
            beta[i] += beta[j] * table[p][k]
    return [(p, alpha[i] * table[p][k] * beta[j] / alpha[-1]) for j, found in enumerate(ends, 1) for i, p in found]


def _expected(model: Model):
    """Expected piece counts from rows ``lang, word, n``."""
    at = {x: k for k, x in enumerate(model.languages)}

    def run(batches):
        table, own = model.table, model
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for lang, word, n in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for p, x in _shares(own.cuts(word), table, at[lang]):
                    share = x * n
                    if share > 1e-9:
                        sums[lang, p] = sums.get((lang, p), 0.0) + share
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([sums[x] for x in keys], pa.float64())], names=["lang", "piece", "n"])

    return run


def _words_of(batches):
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in split_words(text or ""):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([counts[x] for x in keys], pa.int64())], names=["lang", "word", "n"])


def fit(labelled: DataFrame, vocabulary: list[str], *, sample_chars: int = 1_500_000, rounds: int = 2) -> Model:
    """A model from rows ``doc_id, text, lang``, those without a language left out.

    Each language gives about ``sample_chars`` characters of whole texts, drawn by a hash of ``doc_id`` (all of them if it has
    fewer); that bounds the work and what reaches the driver (vocabulary times languages).
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    uniform = 1.0 / max(len(vocabulary), 1)
    model = Model(languages, {p: (uniform,) * len(languages) for p in vocabulary})
    if not languages:
        return model
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, sample_chars / max(sizes[x], 1)))])
    drawn = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    counts = cut(drawn.select("lang", "text").mapInArrow(_words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        summed = counts.mapInArrow(_expected(model), "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # at most vocabulary x languages rows
        weight = {p: [SMOOTH * 0.01] * len(languages) for p in vocabulary}
        for r in summed:
            weight[r["piece"]][languages.index(r["lang"])] += r["n"]
        totals = [math.fsum(w[k] for w in weight.values()) for k in range(len(languages))]
        model = Model(languages, {p: tuple(x / t for x, t in zip(w, totals, strict=True)) for p, w in weight.items()})
    return model


def _predict(model: Model, ids: list[str]):
    def run(batches):
        own = Scorer(model)
        for batch in batches:
            languages, scores = [], []
            for part in range(0, len(batch), PART):  # the words of some texts are learned together
                split = [split_words(x.as_py() or "") for x in batch.column("text").slice(part, PART)]
                if model.languages:
                    own.learn([w for words in split for w in words])
                for words in split:
                    if not model.languages or not any(any(map(str.isalpha, w)) for w in words):
                        languages.append("und")
                        scores.append(0.0)
                        continue
                    total = own.total(words)
                    k = int(np.argmax(total))
                    languages.append(model.languages[k])
                    scores.append(float(1.0 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*ids, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, with_key: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned.  Ties go to the first language by name; further columns are ignored.

    ``with_key`` adds ``text_key`` after ``doc_id``, which tells rows of one ``doc_id`` with different texts apart.
    """
    ids = ["doc_id", "text_key"] if with_key else ["doc_id"]
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).select(*ids, "text")
    schema = T.StructType([*[rows.schema[c] for c in ids], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(model, ids), schema)


def held_out() -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, *, sample_chars: int = 1_500_000) -> Model:
    """The production model: the rows that are not held out, pieces of the public vocabulary of 32,000."""
    return fit(docs.where(~held_out()), pieces(public_tokenizers.path("piece_bpe_32k.model")), sample_chars=sample_chars)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
