"""Problem 9: the subjects each document is about.

Method: classifier chains over term, source and structure features. A first linear model scores terms by subject; it
gives every term the subject that the rest of its sentence (else of its document) speaks of, so that a word of
several meanings gets a weight for each company it keeps. The chain then has one logistic model a subject, each with
the subjects before it as features, which models their co-occurrence. Its probabilities are calibrated on held-out
labelled documents: Platt scaling, then division by the chance that a true subject was labelled at all, since labels
are missing; that chance is the median probability of the held-out documents that have the label. Beam search finds
the most probable combination of subjects.

Words inside short quotation marks are mentions (names, quoted words): they are features of their own and never count
as terms. The model is fitted on the driver from at most SAMPLE labelled documents of LONGEST characters at most,
chosen by the hash of their id; the translation beside a text is a second example with the same labels. Every document
is classified by its whole text alone. Texts are read word by word; features, scores and the beam are arrays over a
batch. Null, empty and blank texts have no subject; without labels or documents nothing has one.
"""

from __future__ import annotations

import html
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
LONGEST = 8_000
BEAM = 8
RIDGE = 3e-4
LEAST = 4
MAX_SUBJECTS = 1000
_QUOTE_MARKS = '"“”„«»'
_QUOTED = re.compile(r"""["“”„«»]([^"“”„«»]{1,80})["“”„«»]""")
_SENTENCE = re.compile(r"[.!?]+[\s\"“”»]+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_DIGIT = re.compile(r"\d")
_INVISIBLE = re.compile("[­​-‏⁠﻿�]")
_BROKEN = re.compile("[ÃÂÐÑâ][\u0080-ÿŒ-™]")


def clean(text: str) -> str:
    """Entities, invisible characters and doubly encoded text repaired."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", text)
    if _BROKEN.search(text):
        for wrong in ("cp1252", "latin-1"):
            try:
                return text.encode(wrong).decode("utf-8")
            except UnicodeError:
                pass
    return text


def sentences(text: str) -> tuple[list[list[str]], list[str]]:
    """(terms of each sentence, mentioned words)."""
    text = clean(text)
    mentions: list[str] = []

    def mention(m):
        inner = m.group(1).strip()
        if len(inner.split()) <= 4 and not inner.endswith((",", ".", "?", "!")):
            mentions.extend(w.lower() for w in _WORD.findall(inner))
            return " § "
        return m.group(0)

    if any(q in text for q in _QUOTE_MARKS):
        text = _QUOTED.sub(mention, text)
    find = _WORD.findall
    return [s for s in (find(part) for part in _SENTENCE.split(text.lower())) if s], mentions


class Read:
    """A batch of texts as flat arrays: words with their sentence and document, mentions, and structure marks."""

    def __init__(self, docs: list[tuple[str, str | None]]):
        self.n = len(docs)
        self.words: list[str] = []
        self.mentions: list[str] = []
        self.marks: list[tuple[str, ...]] = []
        sizes, owners, mentioned = [], [], []
        for i, (text, source) in enumerate(docs):
            parts, mentions = sentences(text)
            for s in parts:
                self.words += s
                sizes.append(len(s))
            owners += [i] * len(parts)
            self.mentions += mentions
            mentioned += [i] * len(mentions)
            self.marks.append((f"src:{source}", f"n:{min(len(parts), 6)}", f"ment:{min(len(mentions), 3)}", f"dig:{_DIGIT.search(text) is not None}", f"up:{text.isupper()}"))
        self.sentence = np.repeat(np.arange(len(sizes)), sizes)
        self.doc_of_sentence = np.array(owners, np.int64)
        self.doc = self.doc_of_sentence[self.sentence] if len(sizes) else np.zeros(0, np.int64)
        self.mention_doc = np.array(mentioned, np.int64)


def _numbers(known: dict[str, int], texts: list[str]) -> np.ndarray:
    return np.fromiter(map(known.get, texts, repeat(-1)), np.int64, len(texts))


def _number(texts: list[str], least: int) -> dict[str, int]:
    """Numbers of the texts that stand there least times."""
    count: dict[str, int] = {}
    for x in texts:
        count[x] = count.get(x, 0) + 1
    return {x: i for i, x in enumerate(sorted(x for x, c in count.items() if c >= least))}


class Features:
    """Numbers features: words, their beginnings, pairs of neighbours, mentions, marks, and words with their company.

    A feature is a 64-bit key (its kind in the upper bits); those in LEAST documents at least are columns.
    """

    def __init__(self, read: Read, k: int, least: int = LEAST):
        self.k, self.least = k, least
        self.word = _number(read.words + read.mentions, least)
        self.start = _number([w[:5] for w in read.words if len(w) > 5], least)
        self.start_of_word = np.array([self.start.get(w[:5], -1) if len(w) > 5 else -1 for w in self.word], np.int64)
        self.mark = _number([m for row in read.marks for m in row], 1)
        self.term: np.ndarray | None = None  # weights of the first model by word and subject
        self.columns = np.zeros(0, np.int64)

    def keys(self, read: Read) -> tuple[np.ndarray, np.ndarray]:
        """(document, key), repeats included; every document has a key 0."""
        w = _numbers(self.word, read.words)
        known = w >= 0
        docs, keys = [np.arange(read.n)], [np.zeros(read.n, np.int64)]

        def add(kind: int, doc: np.ndarray, payload: np.ndarray) -> None:
            docs.append(doc)
            keys.append((np.int64(kind) << 56) | payload)

        add(1, read.doc[known], w[known])
        starts = np.where(known, self.start_of_word[w] if len(self.start_of_word) else -1, -1)
        new = np.flatnonzero(~known)
        starts[new] = _numbers(self.start, [read.words[i][:5] if len(read.words[i]) > 5 else "" for i in new.tolist()])
        add(2, read.doc[starts >= 0], starts[starts >= 0])
        pair = np.flatnonzero(known[1:] & known[:-1] & (read.sentence[1:] == read.sentence[:-1])) if len(w) else np.zeros(0, np.int64)
        add(3, read.doc[pair], (w[pair] << 26) | w[pair + 1])
        m = _numbers(self.word, read.mentions)
        add(4, read.mention_doc[m >= 0], m[m >= 0])
        marks = _numbers(self.mark, [x for row in read.marks for x in row])
        owner = np.repeat(np.arange(read.n), [len(row) for row in read.marks])
        add(5, owner[marks >= 0], marks[marks >= 0])
        if self.term is not None:
            own = self._company(read, w)
            add(6, own[0], own[1])
        return np.concatenate(docs), np.concatenate(keys)

    def _company(self, read: Read, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each telling word the subject that the other words of its sentence, else of its document, point to."""
        mine = np.where((w >= 0)[:, None], self.term[np.maximum(w, 0)], 0) if len(self.term) else np.zeros((len(w), self.k))
        sums = np.zeros((len(read.doc_of_sentence), self.k))
        every = np.zeros((read.n, self.k))
        for t in range(self.k):
            sums[:, t] = np.bincount(read.sentence, mine[:, t], len(sums)) if len(w) else 0
            every[:, t] = np.bincount(read.doc, mine[:, t], read.n) if len(w) else 0
        at = np.flatnonzero(np.abs(mine).max(axis=1, initial=0) >= 0.3)
        near, far = sums[read.sentence[at]] - mine[at], every[read.doc[at]] - mine[at]
        by_near, by_far = near.max(axis=1, initial=0) > 1, far.max(axis=1, initial=0) > 1
        company = np.where(by_near, near.argmax(axis=1), np.where(by_far, self.k + far.argmax(axis=1), 2 * self.k)) if self.k else np.zeros(0, np.int64)
        return read.doc[at], w[at] * (2 * self.k + 1) + company

    def learn(self, read: Read) -> "Matrix":
        """Chooses the columns and returns the texts' matrix."""
        doc, key = self.keys(read)
        names, at = np.unique(key, return_inverse=True)
        pairs = np.unique(doc * len(names) + at)
        enough = np.bincount(pairs % len(names), minlength=len(names)) >= np.where(names == 0, 1, self.least)
        self.columns = names[enough]
        pairs = pairs[enough[pairs % len(names)]]
        return Matrix(pairs // len(names), (np.cumsum(enough) - 1)[pairs % len(names)], len(doc) and read.n, len(self.columns))

    def matrix(self, read: Read) -> "Matrix":
        doc, key = self.keys(read)
        at = np.minimum(np.searchsorted(self.columns, key), len(self.columns) - 1)
        ok = self.columns[at] == key
        pairs = np.unique(doc[ok] * len(self.columns) + at[ok])
        return Matrix(pairs // len(self.columns), pairs % len(self.columns), read.n, len(self.columns))


class Matrix:
    """Rows of column numbers, sorted by row; every row has column 0, as key 0 is in every text."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int):
        self.row, self.column, self.rows, self.columns = row, column, rows, columns
        self.start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        self._by_column = None

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.column], self.start, axis=0) if self.rows else np.zeros((0, w.shape[1]), w.dtype)

    def back(self, g: np.ndarray) -> np.ndarray:
        """Sums of g by column; every column has a row in the texts it was learned from."""
        if self._by_column is None:
            order = np.argsort(self.column, kind="stable")
            column = self.column[order]
            self._by_column = self.row[order], np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        return np.add.reduceat(g[self._by_column[0]], self._by_column[1], axis=0)


def fit(x: Matrix, extra: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 30, ridge: float = RIDGE, memory: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic models for all columns of y at once, by L-BFGS over all rows: (weights, weights of extra, bias)."""
    n, k = y.shape
    a, b = x.columns * k, x.columns * k + extra.shape[1] * k
    y, extra = y.astype(np.float32), extra.astype(np.float32)

    def parts(p):
        return p[:a].reshape(-1, k), p[a:b].reshape(-1, k) * mask, p[b:]

    def loss(p):
        w, link, bias = parts(p)
        z = x.dot(w) + extra @ link + bias
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        value = float((np.logaddexp(0, z) - y * z).sum(dtype=np.float64)) / n + ridge / 2 * float((w * w).sum(dtype=np.float64) + (link * link).sum(dtype=np.float64))
        g = ((q - y) / n).astype(np.float32)
        return value, np.concatenate(((x.back(g) + ridge * w).ravel(), ((extra.T @ g) * mask + ridge * link).ravel(), g.sum(0))).astype(np.float32)

    p = np.zeros(b + k, np.float32)
    p[b:] = -2
    value, grad = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d = grad.copy()
        kept = []
        for s, u, rho in reversed(past):
            c = rho * float(s @ d)
            d -= c * u
            kept.append(c)
        d *= float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else 1 / max(float(np.sqrt(grad @ grad)), 1e-9)
        for (s, u, rho), c in zip(past, reversed(kept)):
            d += (c - rho * float(u @ d)) * s
        slope, rate = float(grad @ d), 1.0
        if slope <= 1e-10:
            break
        while True:
            new = p - rate * d
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * rate * slope or rate < 1e-4:
                break
            rate /= 2
        s, u = new - p, new_grad - grad
        if float(s @ u) > 1e-12:
            past = [*past, (s, u, 1 / float(s @ u))][-memory:]
        done = value - new_value < 1e-7 * max(1.0, value)
        p, value, grad = new, new_value, new_grad
        if done:
            break
    return parts(p)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the calibrated logit a z + b, by Newton steps with a weak prior at (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = q * (1 - q)
        ga, gb = ((q - y) * z).sum() + (a - 1), (q - y).sum() + b
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        da, db = np.linalg.solve(h, [ga, gb])
        a, b = a - da, b - db
    return float(max(a, 0.1)), float(b)


class Chain:
    """The fitted chain, a plain value to broadcast."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        k = len(subjects)
        self.mask = np.triu(np.ones((k, k), np.float32), 1)  # a model sees the subjects before its own

    def fit(self, docs: list[tuple[str, str | None]], y: np.ndarray, held: np.ndarray) -> "Chain":
        k = len(self.subjects)
        train, test = np.flatnonzero(~held), np.flatnonzero(held)
        read = Read([docs[i] for i in train])
        self.features = f = Features(read, k)
        first, _, _ = fit(f.learn(read), np.zeros((len(train), 0)), y[train], np.zeros((0, k), np.float32))
        f.term = np.zeros((len(f.word), k))
        words = f.columns >> 56 == 1
        f.term[f.columns[words] & ((1 << 56) - 1)] = first[words]
        self.w, self.link, self.bias = fit(f.learn(read), y[train], y[train], self.mask)
        # calibration apart for documents without and with a subject earlier in the chain: labels miss more often there
        self.scale = np.tile(np.array([1.0, 0.0]), (2, k, 1))
        self.found = np.ones(2)
        if len(test):
            z = f.matrix(Read([docs[i] for i in test])).dot(self.w) + y[test] @ self.link + self.bias
            before = (y[test] @ self.mask) > 0
            for g in (0, 1):
                sure = []
                for j in range(k):
                    own = before[:, j] == bool(g)
                    zj, yj = z[own, j], y[test][own, j]
                    self.scale[g, j] = a, b = platt(zj, yj)
                    sure.append((1 / (1 + np.exp(-(a * zj + b))))[yj > 0])
                sure = np.concatenate(sure)
                self.found[g] = np.median(sure) if len(sure) else 1.0
        return self

    def decode(self, docs: list[tuple[str, str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """(document, subject) of the most probable combination of each document, by beam search along the chain."""
        z = self.features.matrix(Read(docs)).dot(self.w) + self.bias
        n, k = z.shape
        score = np.full((n, 1), 0.0)
        chosen = np.zeros((n, 1, k), bool)
        linked = np.zeros((n, 1, k))
        for j in range(k):
            g = chosen.any(axis=2).astype(np.int64)
            logit = self.scale[g, j, 0] * (z[:, j, None] + linked[:, :, j]) + self.scale[g, j, 1]
            p = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))) / self.found[g], 1e-6, 1 - 1e-6)
            grown = np.concatenate((score + np.log(1 - p), score + np.log(p)), axis=1)
            best = np.argsort(-grown, axis=1, kind="stable")[:, :BEAM]
            score = np.take_along_axis(grown, best, 1)
            with_it, of = best >= logit.shape[1], best % logit.shape[1]
            chosen = np.take_along_axis(chosen, of[:, :, None], 1)
            linked = np.take_along_axis(linked, of[:, :, None], 1)
            chosen[:, :, j] = with_it
            linked += with_it[:, :, None] * self.link[j]
        return np.nonzero(chosen[:, 0])


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """At most sample labelled documents of LONGEST characters at most: text, target_text, source, their subjects."""
    own = labels.select(F.col("doc_id").alias("id"), "subject").filter("id is not null").groupBy("id").agg(F.collect_set("subject").alias("subjects"))
    columns = ["text", "source"] + (["target_text"] if "target_text" in documents.columns else [])
    found = documents.select(F.col("doc_id").alias("id"), *columns).filter(F.length("text") <= LONGEST).join(own, "id")
    if "target_text" in columns:
        found = found.withColumn("target_text", F.when(F.length("target_text") <= LONGEST, F.col("target_text")))
    return found.orderBy(F.xxhash64("id"), "id", "text").limit(sample).collect()


def train(rows: list, subjects: list[str]) -> Chain | None:
    """The chain of the labelled rows; every fifth is held out to calibrate."""
    at = {s: i for i, s in enumerate(subjects)}
    docs, ys, held = [], [], []
    for i, r in enumerate(rows):
        y = np.zeros(len(subjects))
        y[[at[s] for s in r["subjects"] if s in at]] = 1
        texts = [r["text"]] + ([r["target_text"]] if "target_text" in r and i % 5 else [])
        for text in texts:
            if text and text.strip():
                docs.append((text, r["source"]))
                ys.append(y)
                held.append(i % 5 == 0)
    if not docs or all(held):
        return None
    return Chain(subjects).fit(docs, np.array(ys), np.array(held))


def _classify(chain):
    def run(batches):
        model = chain.value
        names = pa.array(model.subjects, pa.string())
        for batch in batches:
            text = batch.column(1).to_pylist()
            some = np.array([i for i, t in enumerate(text) if t and t.strip()], np.int64)
            source = batch.column(2).to_pylist()
            for at in range(0, len(some), 2000):
                rows = some[at : at + 2000]
                doc, subject = model.decode([(text[i], source[i]) for i in rows.tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[doc])), names.take(pa.array(subject))], names=["doc_id", "subject"])

    return run


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, subject): every subject of every document. subjects is read to the driver, MAX_SUBJECTS distinct ones at most."""
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in subjects.select("subject").filter("subject <> ''").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects are listed")
    chain = train(labelled(documents, labels, sample), names) if names else None
    if chain is None:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    model = spark.sparkContext.broadcast(chain)  # bounded by the sample
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return texts.mapInArrow(_classify(model), "doc_id bigint, subject string")
