"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings (also: that
they occur several times). It is fitted on a bounded sample of labelled
documents; besides the usual loss, sentences of the sample that
mention an identity group are paired with the same sentences naming another
group, and any change of the score between the two is penalised, so that a
neutral mention of a group does not raise it.

Features are chosen by how surely they tell the labels apart (a likelihood
ratio, in each of two halves of the sample that do not share copies). The
fitted weights (at most ``FEATURES``) travel to the tasks that score every
whole text in one pass, without a shuffle."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.storage import stored

#: Labelled documents that a model is fitted on, about (chosen by a hash).
SAMPLE_DOCS = 10_000
#: Features of a model, at most; the least document count and surety of each.
FEATURES, MIN_DOCS, MIN_SURETY = 600, 5, 3.0
#: Characters of a word beginning, and numbers of occurrences that are features.
BEGINNINGS, TIMES = (4, 5, 6), (1, 2, 4)
#: Weights of the ridge and of the squared score changes, rounds of the fit.
RIDGE, FAIRNESS, ROUNDS = 2e-4, 1.0, 600
#: Identity terms by group kind (fixed values); terms of one line are swapped. Another table is an argument of ``fit``.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "hispanic", "arab"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall((text or "").lower())


def features_of(words: list[str], starts: set[str] | None = None) -> set[str]:
    """Features of a text: each word ("word$") and its beginnings, marked with
    each number of times that they occur at least. With ``starts``, only of
    words whose first four letters are among them."""
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        if starts is None or word[:BEGINNINGS[0]] in starts:
            counts[word + "$"] += n
            for k in BEGINNINGS:
                if len(word) >= k:
                    counts[word[:k]] += n
    return {f"{f}|{least}" for f, n in counts.items() for least in TIMES if n >= least}


def swaps(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    """Each identity term with the others of its line."""
    return {t: tuple(o for o in line if o != t) for line in terms for t in line}


def counterfactuals(text: str | None, other: dict[str, tuple[str, ...]]) -> list[tuple[list[str], list[str]]]:
    """(words, words with the term swapped) for each sentence that names a
    group and each other group of that kind."""
    out = []
    for sentence in SENTENCE.split((text or "").lower()):
        words = WORD.findall(sentence)
        for term in sorted(set(words) & other.keys()):
            out += [(words, [new if w == term else w for w in words]) for new in other[term]]
    return out


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.starts = {f.split("|")[0].rstrip("$")[:BEGINNINGS[0]] for f in self.weights}

    def score(self, text: str | None) -> float:
        found = self.weights.keys() & features_of(words_of(text), self.starts)
        return float(1.0 / (1.0 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(found))))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of about ``most`` labelled rows that are not held out, one
    id in so many by a hash; the ids are chosen among the labels and travel to
    the documents, so no text is shuffled. Conflicting labels of an id: the
    greater."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    share = min(1.0, most / max(1, usable.count()))
    chosen = (usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    chosen = chosen.select(F.col("doc_id").alias("chosen"), F.col("toxic").cast("int").alias("toxic"))
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("text", "toxic")


def sample_rows(sample: DataFrame, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> DataFrame:
    """One row for each distinct text of the sample: toxic, half, features,
    and the features that each counterfactual sentence (a term of ``terms``
    swapped) loses and gains. A text and what begins like it are in one half."""
    changed = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("gone", "new")])
    schema = T.StructType([T.StructField("digest", T.LongType()), T.StructField("half", T.IntegerType()),
                           T.StructField("toxic", T.IntegerType()),
                           T.StructField("features", T.ArrayType(T.StringType())),
                           T.StructField("changes", T.ArrayType(changed))])
    strings = pa.list_(pa.string())
    kinds = [pa.int64(), pa.int32(), pa.int32(), strings, pa.list_(pa.struct([("gone", strings), ("new", strings)]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = swaps(terms)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, rows = b.slice(at, 200), []
                for text, toxic in zip(part.column(0), part.column(1), strict=True):
                    text = (text.as_py() or "").lower()
                    changes = []
                    for old, new in counterfactuals(text, other):
                        old, new = features_of(old), features_of(new)
                        changes.append({"gone": sorted(old - new), "new": sorted(new - old)})
                    rows.append((xxhash.xxh64_intdigest(text) >> 1, xxhash.xxh64_intdigest(text[:24]) & 1,
                                 toxic.as_py(), sorted(features_of(words_of(text))), changes))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=schema.names)

    return sample.mapInArrow(run, schema).dropDuplicates(["digest"])


def _surety(positive: Column, count: Column, positives: int, total: int) -> Column:
    """Signed root of the likelihood ratio of a word's counts by label."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    share = max(positives, 1) / max(total, 1)
    negative, rest = count - positive, F.lit(total) - count
    cells = [(positive, count * share), (negative, count * (1 - share) + 1e-9),
             (F.lit(positives) - positive, rest * share + 1e-9),
             (F.lit(total - positives) - negative, rest * (1 - share) + 1e-9)]
    ratio = part(*cells[0]) + part(*cells[1]) + part(*cells[2]) + part(*cells[3])
    return F.signum(positive - count * share) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def choose_features(rows: DataFrame) -> list[str]:
    """Features that tell the labels apart in both halves, surest first."""
    sizes = {r.half: (r.n, r.p) for r in rows.groupBy("half").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
             .collect()}
    counts = rows.select("half", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        *[F.count(F.when(F.col("half") == h, 1)).alias(f"n{h}") for h in (0, 1)],
        *[F.sum(F.when(F.col("half") == h, F.col("toxic")).otherwise(0)).alias(f"p{h}") for h in (0, 1)])
    sure = [_surety(F.col(f"p{h}"), F.col(f"n{h}"), sizes.get(h, (0, 0))[1], sizes.get(h, (0, 0))[0]) for h in (0, 1)]
    both = F.when(F.signum(sure[0]) == F.signum(sure[1]), F.least(F.abs(sure[0]), F.abs(sure[1]))).otherwise(0.0)
    found = counts.where(F.col("n0") + F.col("n1") >= MIN_DOCS).select("feature", both.alias("surety")).where(
        F.col("surety") >= MIN_SURETY).orderBy(F.desc("surety"), "feature").limit(FEATURES).collect()
    return [r.feature for r in found]


def change_products(rows: DataFrame, features: list[str]) -> np.ndarray:
    """Mean of change x change over all counterfactual pairs that gain (1) or
    lose (-1) some of ``features``; zero without such pairs. The products are
    summed in the tasks and then by cell in Spark, so every pair counts and the
    driver gets one number a cell of the matrix."""
    place = {f: k for k, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pairs = np.zeros((len(place), len(place))), 0
        for b in batches:
            for changes in b.column(0):
                for pair in changes or ():
                    moved = {place[f.as_py()]: sign for side, sign in (("gone", -1.0), ("new", 1.0))
                             for f in pair[side].values if f.as_py() in place}
                    if moved:
                        at, signs = list(moved), np.array(list(moved.values()))
                        sums[np.ix_(at, at)] += np.outer(signs, signs)
                        pairs += 1
        if pairs:
            a, b = np.nonzero(sums)
            columns = [np.append(a, -1), np.append(b, -1), np.append(sums[a, b], float(pairs))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "total"])

    mean = np.zeros((len(place), len(place)))
    pairs = 1.0
    if place:
        for r in (rows.where(F.size("changes") > 0).select("changes").mapInArrow(run, "a long, b long, total double")
                  .groupBy("a", "b").agg(F.sum("total").alias("total")).collect()):
            if r.a < 0:
                pairs = r.total
            else:
                mean[r.a, r.b] = r.total
    return mean / pairs


def fit_weights(x: np.ndarray, y: np.ndarray, changes: np.ndarray, ridge: float = RIDGE, fairness: float = FAIRNESS,
                rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on mean log loss + ridge |w|^2
    + fairness * mean (w . change)^2, ``changes`` being the mean of change x change."""
    n, k = x.shape
    full = np.concatenate([x, np.ones((n, 1))], 1).astype(float)   # one type: no copy of the matrix a round
    reach = np.linalg.norm(full.T @ full / n, 2) / 4 + 2 * ridge
    changes = 2 * fairness * changes
    some = changes.any()
    if some:
        reach += np.linalg.norm(changes, 2)
    w = step = np.zeros(k + 1)
    w[k] = step[k] = 0.0
    for t in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(full @ step)))
        gradient = full.T @ (p - y) / n
        gradient[:k] += 2 * ridge * step[:k]
        if some:
            gradient[:k] += changes @ step[:k]
        new = step - gradient / reach
        step = new + t / (t + 3) * (new - w)
        w = new
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        most: int = SAMPLE_DOCS, fairness: float = FAIRNESS,
        terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Classifier:
    """A classifier from the labelled rows that are not held out (about
    ``most`` of them); ``terms`` is the table of identity terms that are
    swapped. Without labelled rows every score is 0; with one label only it is
    that label's smoothed share, (toxic texts + 1) / (texts + 2)."""
    rows = stored(sample_rows(labelled_sample(docs, labels, most, id_col, text_col), terms), "toxicity-sample")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
    if not total.n:
        return Classifier({}, float("-inf"))
    if total.p in (0, total.n):
        return Classifier({}, math.log((total.p + 1) / (total.n - total.p + 1)))
    features = choose_features(rows)
    chosen = F.broadcast(rows.sparkSession.createDataFrame([(f,) for f in features], "feature string"))
    numbered = rows.select("toxic", "features", F.monotonically_increasing_id().alias("row"))
    used = (numbered.select("row", F.explode("features").alias("feature")).join(chosen, "feature")
            .groupBy("row").agg(F.collect_list("feature").alias("used")))
    found = numbered.select("row", "toxic").join(used, "row", "left").orderBy("row").collect()
    place = {f: k for k, f in enumerate(features)}
    x, y = np.zeros((len(found), len(features)), np.float32), np.array([r.toxic for r in found], float)
    for row, r in enumerate(found):
        x[row, [place[f] for f in r.used or ()]] = 1.0
    weights, bias = fit_weights(x, y, change_products(rows, features), fairness=fairness)
    return Classifier({f: float(v) for f, v in zip(features, weights, strict=True) if v}, bias)


def score_documents(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Null texts count as
    empty (the score of no words); repeated rows and null ids give a row each;
    an empty table none; only the id (for held_out) and the text are read."""
    scored = with_scores(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), classifier)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_score (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    own = docs.drop("toxic_score")
    place = own.columns.index(text_col)
    schema = T.StructType([*own.schema.fields, T.StructField("toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = pa.array([model.score(x.as_py()) for x in b.column(place)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=schema.names)

    return own.mapInArrow(run, schema)
