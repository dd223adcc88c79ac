"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. A word's likelihood is the
sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its
words. The probabilities start from how often pieces occur in words of the language and are
re-estimated by expectation maximisation over all segmentations.

Words are runs of letters of the lower-cased text with a space before, as UTF-8 bytes. The fit reads
a bounded sample: about `per_language` labelled documents of each language, and no more than about
SAMPLE bytes of its texts, chosen by a hash of the key. Prediction reads every word of every text.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from souk.llm.rawtext import Lookup, Spans, kept_one, text_lists

STEPS = 16  # bytes after which sums are rescaled
SAMPLE = 8_000_000  # bytes of text that a language gives to the fit
FEW = 100_000  # languages whose sizes may be sent to every task
CACHE = 150_000  # words whose likelihoods a worker remembers; a full cache is emptied
BATCH = 1_000_000  # bytes of text handled at once
LETTERS = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    languages: list[str]
    pieces: np.ndarray  # sorted hashes of the vocabulary
    chances: np.ndarray  # piece by language; the last row, for no piece, is 0
    longest: int  # bytes of the longest piece


def vocabulary(path: str) -> tuple[np.ndarray, int]:
    """Sorted hashes of the pieces of a public vocabulary file, one in Base64 per line, and the bytes of the longest."""
    with open(path, "rb") as f:
        pieces = [p for p in (base64.b64decode(line.split()[0]) for line in f if line.strip()) if p]
    return np.unique(_hashes(pieces)), max(map(len, pieces), default=0)


def _hashes(pieces: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(p) for p in pieces])
    return Spans(np.frombuffer(b"".join(pieces), np.uint8))(ends - [len(p) for p in pieces], ends)


def words_of(text: str) -> list[str]:
    return LETTERS(text.lower())


class Lattice:
    """The pieces at every place of words of one length: of[l][:, t] are those of l bytes from byte t."""

    def __init__(self, spans: Spans, starts: np.ndarray, size: int, known: Lookup, longest: int):
        self.n, self.size, self.longest, self.of = len(starts), size, longest, {}
        for width in range(1, min(size, longest) + 1):
            begin = (starts[:, None] + np.arange(size - width + 1)).ravel()
            found, which = known(spans(begin, begin + width))
            if len(found):
                ids = np.full(len(begin), len(known.values), np.int32)
                ids[found] = which
                self.of[width] = ids.reshape(len(starts), -1)

    def sums(self, chances: np.ndarray, back: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sums over all segmentations up to each byte (or from it on), and the logarithm of what was divided out of each."""
        sums, logs = [np.ones((self.n, chances.shape[1]))] * (self.size + 1), [np.zeros((self.n, 1))] * (self.size + 1)
        order = range(self.size - 1, -1, -1) if back else range(1, self.size + 1)
        for step, t in enumerate(order, 1):
            a = np.zeros((self.n, chances.shape[1]))
            for width, ids in self.of.items():
                if width <= step:
                    first, from_ = (t, t + width) if back else (t - width, t - width)
                    a += sums[from_] * chances[ids[:, first]]
            sums[t], logs[t] = a, logs[t + 1 if back else t - 1]
            if step % STEPS == 0 and step < self.size:
                most = a.max(axis=1, keepdims=True)
                most[most == 0] = 1
                for j in range(t, min(self.size, t + self.longest) + 1) if back else range(max(0, t - self.longest), t + 1):
                    sums[j], logs[j] = sums[j] / most, logs[j] + np.log(most)
        return sums, logs

    def forward(self, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum over all segmentations, and the logarithm of what was divided out of it."""
        sums, logs = self.sums(chances)
        return sums[-1], logs[-1]

    def expected(self, chances: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        """Adds each piece's expected uses."""
        ahead, ahead_logs = self.sums(chances)
        behind, behind_logs = self.sums(chances, back=True)
        total = ahead[-1]
        share = np.divide(weights, total, out=np.zeros_like(total), where=total > 0)
        for w, ids in self.of.items():
            for t in range(ids.shape[1]):
                use = ahead[t] * chances[ids[:, t]] * behind[t + w] * share
                if self.size > STEPS:
                    use *= np.exp(ahead_logs[t] + behind_logs[t + w] - ahead_logs[-1])
                for k in range(out.shape[1]):
                    out[:, k] += np.bincount(ids[:, t], use[:, k], len(out))


def _lattices(words: list[str], known: Lookup, longest: int, most: int = 20_000) -> Iterator[tuple[np.ndarray, Lattice]]:
    raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    spans = Spans(np.frombuffer(b"".join(raw), np.uint8))
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        for a in range(0, len(of), most):
            yield of[a : a + most], Lattice(spans, starts[of[a : a + most]], size, known, longest)


def likelihoods(words: list[str], model: Model) -> np.ndarray:
    """Natural logarithm of each word's likelihood in each language."""
    out = np.zeros((len(words), len(model.languages)))
    for of, lattice in _lattices(words, Lookup(model.pieces), model.longest):
        sums, scale = lattice.forward(model.chances)
        with np.errstate(divide="ignore"):
            out[of] = np.maximum(np.log(sums), -1e6) + scale
    return out


def fit(counts: dict[str, Counter], pieces: np.ndarray, longest: int, rounds: int = 3, smooth: float = 0.05) -> Model:
    """counts: of each language's words."""
    languages, known = sorted(counts), Lookup(pieces)
    words = sorted({w for c in counts.values() for w in c})
    weights = np.array([[counts[k][w] for k in languages] for w in words], float).reshape(len(words), len(languages))

    def chances(uses: np.ndarray) -> np.ndarray:
        p = (uses[:-1] + smooth) / (uses[:-1].sum(axis=0) + smooth * len(pieces))
        return np.vstack([p, np.zeros(len(languages))])

    start = np.zeros((len(pieces) + 1, len(languages)))
    for of, lattice in _lattices(words, known, longest):
        for ids in lattice.of.values():
            for t in range(ids.shape[1]):
                for k in range(len(languages)):
                    start[:, k] += np.bincount(ids[:, t], weights[of, k], len(start))
    p = chances(start)
    for _ in range(rounds):
        uses = np.zeros_like(start)
        for of, lattice in _lattices(words, known, longest):
            lattice.expected(p, weights[of], uses)
        p = chances(uses)
    return Model(languages, pieces, p, longest)


def learn(docs: DataFrame, words: tuple[np.ndarray, int], key: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, per_language: int = 400, rounds: int = 3) -> Model:
    """Fits the pieces of vocabulary() on about per_language documents of each language among those that meet `train`.

    Rows without text or language are left out; without any, the model has no language.
    """
    rows = docs if train is None else docs.where(train)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"), F.lit(float(SAMPLE)) / F.greatest("bytes", F.lit(1)))
    place = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit("fit")), F.lit(1_000_000)) / 1e6
    sizes = F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes
    sample = rows.join(sizes, "lang").where(place < share).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for name, x in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((name, w) for w in words_of(x))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    table = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for k, w, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(k, Counter())[w] = n
    return fit(counts, *words, rounds)


class Scorer:
    """Likelihoods of words, remembered, and their sums over texts."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum for each language, and the number of words with a letter."""
        each = [words_of(x) if x else [] for x in texts]
        if len(self.known) > CACHE:
            self.known, self.rows = {}, self.rows[:0]
        new = [w for w in set().union(*each) if w not in self.known]
        real = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        self.known.update(dict.fromkeys(new, -1))
        self.known.update(zip(real, range(len(self.rows), len(self.rows) + len(real)), strict=True))
        self.rows = np.vstack([self.rows, likelihoods(real, self.model)])
        at = np.fromiter((i for ws in each for i in map(self.known.__getitem__, ws)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in each])[at >= 0]
        at = at[at >= 0]
        sums = np.stack([np.bincount(owner, self.rows[at, k], len(texts)) for k in range(self.rows.shape[1])], axis=1) if self.rows.shape[1] else np.zeros((len(texts), 0))
        return sums, np.bincount(owner, minlength=len(texts))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, lang_pred, score (the predicted language's posterior under equal priors, 0 to 1),
    n_letter_words, and the columns in `keep`, for each row.

    Null texts and texts without a letter get `und` and 0; so do all if the model has no language.
    Ties go to the first language by name. Repeated rows get equal results; null keys are kept.
    """
    body = text if text in keep else "_text"  # sent once
    own = docs.select(F.col(key).alias("_key"), *([] if text in keep else [F.col(text).cast("string").alias("_text")]), *[F.col(f"`{c}`") for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([f"_key {kinds['_key']}", *[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string, score double, n_letter_words bigint"])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    name = ("language", hash(model.chances.tobytes()), tuple(model.languages))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_one(name, lambda: Scorer(model))
        for rows, texts in text_lists(batches, body, BATCH):
            sums, n = scorer(texts)
            names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model.languages:
                best = sums.argmax(axis=1)
                rest = np.exp(np.minimum(sums - sums[np.arange(len(texts)), best][:, None], 0)).sum(axis=1)
                names[n > 0] = np.array(model.languages, object)[best[n > 0]]
                score[n > 0] = (1 / rest)[n > 0]
            yield pa.RecordBatch.from_arrays([rows.column("_key"), *[rows.column(c) for c in keep], pa.array(names, pa.string()), pa.array(score), pa.array(n.astype(np.int64))], schema=arrow)

    return own.mapInArrow(run, schema).withColumnRenamed("_key", key)


def accepted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """All columns of the documents whose language is found with a score of `least` or more.

    A null language becomes the predicted one. Texts without letters, null ones too, go.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    out = predict(rows.withColumn("_id", F.col(names[key])), model, "_id", names[text], tuple(names.values()))
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*[(F.coalesce(n, "lang_pred") if c == lang else F.col(n)).alias(c) for c, n in names.items()])
