"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with a probability that a
logistic model gives to its words, and a document if any of its sentences is:
score = 1 - product(1 - p). The model learns from labels of documents only; its
sentence probabilities then tell where the offending sentences are. A sentence
without any word that the model knows as evidence has probability 0, so length
alone makes no text toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Tables
from .words import ALNUM_WORDS, chunks, member, text_buffer, word_hashes, word_spans

#: The model learns from at most so many labelled rows, those with the smallest hash of the id.
SAMPLE_ROWS = 12_000
#: Features that may be evidence: in so many toxic texts of the sample at least, and with so large a signed chi-square.
LEAST_TEXTS = 4
LEAST_CHI2 = 12.0
STEPS, RATE, RIDGE, START = 300, 0.1, 1e-4, -3.0
HELD_OUT = 5

#: Besides each word its first bytes are features, so that one learns from inflected and compound forms.
PREFIXES = (5, 6, 7, 8)

#: Bytes that end a sentence.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % HELD_OUT == 0


class Bags:
    """Words (with their prefixes) and sentences of some texts."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = text_buffer(column)

    def parts(self) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts: the first and last text, the byte they begin at, and of their features the text, sentence, hash and start.

        The features of a word stand side by side: the word, then its prefixes if it is longer.
        """
        for i, j in chunks(self.offsets):
            at = int(self.offsets[i])
            part, own = self.raw[at : self.offsets[j]], self.offsets[i : j + 1] - at
            starts, ends, first = word_spans(part, own, ALNUM_WORDS)
            breaks = np.concatenate(([0], np.cumsum(_ENDS[part])))
            hashes = word_hashes(part, starts, ends, *(np.minimum(ends, starts + k) for k in PREFIXES))
            hashes[1:] ^= np.arange(1, len(hashes), dtype=np.uint64)[:, None]
            real = np.concatenate((np.ones((1, len(starts)), bool), (ends - starts)[None, :] > np.array(PREFIXES)[:, None])).T.ravel()
            copies = len(hashes)
            doc = np.repeat(np.repeat(np.arange(i, j), np.diff(first)), copies)[real]
            yield i, j, at, doc, np.repeat(breaks[starts], copies)[real], hashes.T.ravel()[real], np.repeat(starts, copies)[real]


def _counted(rows: DataFrame, text: str, among: np.ndarray | None = None) -> DataFrame:
    """Rows (feature, n, a): the texts with a feature, and the toxic ones among them; summed within each task first."""
    shared = rows.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, seen, toxic = np.asarray(batch["toxic"]), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j, _, doc, _, hashes, _ in Bags(batch[text]).parts():
                cut = np.searchsorted(doc, np.arange(i, j + 1))
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    own = np.unique(hashes[a:b])
                    own = own if shared.value is None else own[member(own, shared.value)]
                    seen.append(own)
                    toxic.append(np.full(len(own), labels[i + k], np.int64))
            features, inverse = np.unique(np.concatenate(seen), return_inverse=True)
            n = np.bincount(inverse, minlength=len(features)).astype(np.int64)
            a = np.bincount(inverse, weights=np.concatenate(toxic), minlength=len(features)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(n), pa.array(a)], names=["feature", "n", "a"])

    return rows.select("toxic", text).mapInArrow(run, "feature long, n long, a long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


def _bag_rows(rows: DataFrame, text: str, evidence: np.ndarray) -> DataFrame:
    """The evidence in each text: index and sentence, as binary columns."""
    shared = rows.sparkSession.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, shared.value, 0.0)
        for batch in batches:
            words: list[bytes] = []
            sentences: list[bytes] = []
            for i, j, _, doc, sentence, hashes, _ in Bags(batch[text]).parts():
                k = model.lookup(hashes)
                doc, sentence, k = doc[k >= 0], sentence[k >= 0], k[k >= 0]
                cut = np.searchsorted(doc, np.arange(i, j + 1))
                for a, b in zip(cut[:-1], cut[1:]):
                    words.append(k[a:b].astype(np.int32).tobytes())
                    sentences.append((sentence[a:b] - (sentence[a] if b > a else 0)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(words, pa.binary()), pa.array(sentences, pa.binary())], names=["toxic", "words", "sentences"])

    return rows.select("toxic", text).mapInArrow(run, "toxic int, words binary, sentences binary")


class Model:
    """Evidence features (ascending hashes) with their weights, and the bias of a sentence with evidence."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each evidence word, -1 for other words."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[k] == hashes, k, -1)


def fit(features: np.ndarray, bags: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Maximise the likelihood of the labels under the noisy-or, by Adam on all bags at once.

    A bag is its label, and of each of its features the index and the sentence.
    Without evidence every score is 0.
    """
    model = Model(features, np.zeros(len(features)), START)
    if not len(features):
        return model
    entry_word, entry_sentence, sentence_bag, labels = [], [], [], []
    for label, seen, sentences in bags:
        own, local = np.unique(sentences, return_inverse=True)
        entry_word.append(seen)
        entry_sentence.append(local + len(sentence_bag))
        sentence_bag.extend([len(labels)] * len(own))
        labels.append(label)
    word, sentence, bag, label = np.concatenate(entry_word), np.concatenate(entry_sentence).astype(np.int64), np.array(sentence_bag, np.int64), np.array(labels, float)
    theta = np.concatenate((np.full(len(features), 2.0), [START]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, weights=theta[word], minlength=len(bag)) + theta[-1]
        p = _sigmoid(z)
        clean = np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(label))
        given = np.clip(1 - np.exp(clean), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p (1 - y / score), for its bag
        slope = p * (1 - label / given)[bag]
        gradient = np.concatenate((np.bincount(word, weights=slope[sentence], minlength=len(features)), [slope.sum()])) / len(label)
        gradient[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(features, theta[:-1], float(theta[-1]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, tables: Tables | None = None) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out.

    Rows with a null key or label count nowhere; a key with several labels has the
    largest, and of rows with equal keys the one whose text comes first is learnt from. Evidence are features that go with the label by a signed chi-square of
    the 2 x 2 table over the sample; only they and the sentences they are in come to
    the driver, so the bound on the sample bounds everything here. Without labels of
    both kinds there is no evidence.
    """
    tables = tables or Tables(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = tables.write(known.orderBy(F.xxhash64(key), key).limit(rows), "chosen")
    sample = tables.write(docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "toxic").agg(F.min(text).alias(text)).select("toxic", text), "sample")
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    frequent = _counted(sample.where("toxic = 1"), text).where(F.col("a") >= LEAST_TEXTS).select("feature").collect()
    candidates = np.sort(np.array([r[0] for r in frequent], dtype=np.int64).view(np.uint64))
    if not len(candidates) or positive == total:
        return Model(np.zeros(0, np.uint64), np.zeros(0), START)
    b, c = F.col("n") - F.col("a"), F.lit(positive) - F.col("a")
    d = F.lit(total - positive) - b
    lead = (F.col("a") * d - b * c).cast("double")
    chi2 = F.lit(float(total)) * lead * lead / (F.col("n").cast("double") * (c + d) * (F.col("a") + c) * (b + d))
    chosen = _counted(sample, text, candidates).where((lead > 0) & ((c + d == 0) | (chi2 >= LEAST_CHI2))).select("feature").collect()
    features = np.sort(np.array([r[0] for r in chosen], dtype=np.int64).view(np.uint64))
    got = _bag_rows(sample, text, features).collect()
    return fit(features, [(r["toxic"], np.frombuffer(r["words"], np.int32), np.frombuffer(r["sentences"], np.int32)) for r in got])


def _probabilities(model: Model, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every sentence with evidence, in order: its text, the byte where the evidence begins, and its probability."""
    bags = Bags(texts)
    for _, _, at, doc, sentence, hashes, starts in bags.parts():
        k = model.lookup(hashes)
        hit = np.flatnonzero(k >= 0)
        if not len(hit):
            continue
        d, s, w = doc[hit], sentence[hit], model.weights[k[hit]]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]))))
        yield d[new], starts[hit[new]] + at - bags.offsets[d[new]], _sigmoid(np.add.reduceat(w, new) + model.bias)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    clean = np.zeros(len(texts))
    for owner, _, p in _probabilities(model, texts):
        np.add.at(clean, owner, np.log1p(-np.minimum(p, 1 - 1e-12)))
    return 1 - np.exp(clean)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """Rows (key, held_out, score, predicted, n_offending, first_offending) for every whole text; null and empty texts score 0.

    n_offending: sentences with probability 0.5 or more; first_offending: the byte at
    which the first evidence in the first of them begins, else null. With `spans`, an
    array of (byte, probability) for all of them is added.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias))
    names = [key, "score", "n_offending", "first_offending"] + (["offending"] if spans else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            n = len(batch)
            clean, count, first = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64)
            found: list[list[dict]] = [[] for _ in range(n)] if spans else []
            for owner, begin, p in _probabilities(own, batch[text]):
                np.add.at(clean, owner, np.log1p(-np.minimum(p, 1 - 1e-12)))
                bad = p >= 0.5
                np.add.at(count, owner[bad], 1)
                first[owner[bad][::-1]] = begin[bad][::-1]
                if spans:
                    for o, b, x in zip(owner[bad].tolist(), begin[bad].tolist(), p[bad].tolist()):
                        found[o].append({"byte": b, "probability": x})
            columns = [batch[key], pa.array(1 - np.exp(clean)), pa.array(count, pa.int64()), pa.array(first, pa.int64(), mask=first < 0)]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("byte", pa.int64()), ("probability", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, score double, n_offending long, first_offending long" + (", offending array<struct<byte:long,probability:double>>" if spans else "")
    out = docs.select(key, text).mapInArrow(run, schema)
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *names[2:])


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose whole text scores below 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(own, batch[text]) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the labels and score every document."""
    return score(docs, train(docs, labels, key, text), key, text)
