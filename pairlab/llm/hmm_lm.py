"""Hidden Markov language model over words.

Words are counted over all training documents. The commonest ones (at most
``vocabulary``, a fixed bound) are symbols of their own, all others share the
symbol RARE and are told apart by their smoothed frequency; END closes every
text. Latent states are trained by Baum-Welch: expected counts are summed over
the partitions of all training documents, whole texts, in each pass, starting
from a seed that reads no document. A text's probability is the exact likelihood of its
symbols by the scaled forward recursion, times the probability of each rare
word among the rare ones, so that all texts' probabilities sum to one.

Frequent words and the model travel to the tasks (bounded); rare words meet
their counts in a shuffle join, pre-aggregated by row."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.exact_dedup import normalised
from pairlab.llm.storage import stored

WHITE = r"[\x20\x09-\x0D]+"
SMOOTHING = 0.1
#: Words that are symbols of their own, at most.
VOCABULARY = 40_000
STATES = 8
#: Full passes over all training documents.
PASSES = 5
#: Training runs over stretches of this many symbols; scoring over whole texts.
STRETCH = 256
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Symbols processed in step at once.
BATCH_SYMBOLS = 1 << 18
#: Weight of the words' overall frequencies in each state's emissions.
PRIOR = 200.0


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


@dataclass
class Expected:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, symbols: int, states: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def padded(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, symbols in columns of steps, lengths) of batches of
    sequences, longest first, each batch of a bounded number of cells."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    at = 0
    while at < len(order):
        width = len(sequences[order[at]])
        rows = order[at:at + max(1, BATCH_SYMBOLS // max(1, width))]
        lengths = np.array([len(sequences[k]) for k in rows])
        table = np.zeros((width, len(rows)), np.int32)
        for column, k in enumerate(rows):
            table[:lengths[column], column] = sequences[k]
        yield np.array(rows), table, lengths
        at += len(rows)


def log10_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion, all sequences of a batch in step."""
    out = np.zeros(len(sequences))
    for rows, table, lengths in padded(sequences):
        alpha = model.start * model.emit[table[0]]
        total = np.zeros(len(rows))
        active = len(rows)
        for t in range(len(table)):
            if t:
                active = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
                alpha = (alpha[:active] @ model.move) * model.emit[table[t, :active]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:active] += np.log10(scale)
        out[rows] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], opens: np.ndarray, into: Expected) -> None:
    """Baum-Welch: add the expected counts of the sequences; ``opens`` marks
    those that begin a text (others begin in the states' long-run shares)."""
    shares = np.linalg.matrix_power(model.move, 64)[0]
    states = len(shares)
    # emissions relative to their symbol's highest keep 32-bit numbers in range; the factor cancels
    emit = (model.emit / model.emit.max(1, keepdims=True)).astype(np.float32)
    move = model.move.astype(np.float32)
    for rows, table, lengths in padded(sequences):
        width, first = len(table), opens[rows]
        active = np.array([int(np.searchsorted(-lengths, -t, "left")) for t in range(width)])
        alphas, scales, seen = [], [], [emit[table[t, :active[t]]] for t in range(width)]
        alpha = np.where(first[:, None], model.start, shares).astype(np.float32) * seen[0]
        for t in range(width):
            if t:
                alpha = (alpha[:active[t]] @ move) * seen[t]
            scale = alpha.sum(1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            scales.append(scale)
        beta = np.ones((active[-1], states), np.float32)
        gammas, moves = [alphas[-1] * beta], np.zeros((states, states))
        for t in range(width - 2, -1, -1):
            n = active[t + 1]
            ahead = seen[t + 1] * beta / scales[t + 1]
            moves += alphas[t][:n].T @ ahead
            beta = ahead @ move.T
            if active[t] > n:
                beta = np.concatenate([beta, np.ones((active[t] - n, states), np.float32)])
            gammas.append(alphas[t] * beta)
        gammas.reverse()
        into.move += moves * model.move
        into.start += gammas[0][first].sum(0, dtype=np.float64)
        gamma, symbols = np.concatenate(gammas), np.concatenate([table[t, :active[t]] for t in range(width)])
        for k in range(states):
            into.emit[:, k] += np.bincount(symbols, gamma[:, k], minlength=len(into.emit))


def re_estimated(counts: Expected, overall: np.ndarray) -> Model:
    """The next model; no emission is zero."""
    emit = counts.emit + PRIOR * overall[:, None]
    move, start = counts.move + 1.0, counts.start + 1.0
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def stretches(symbols: np.ndarray) -> list[np.ndarray]:
    return [symbols[k:k + STRETCH] for k in range(0, len(symbols), STRETCH)]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 10, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the rows (text) that are not held out, without END: counted
    within each task, COUNTED words at a time, then over the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "c"])

        for b in batches:
            for x in b.column(0):
                counts.update((x.as_py() or "").encode("utf-8").lower().split())
                if len(counts) > COUNTED:
                    yield rows()
                    counts.clear()
        yield rows()

    counted = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """{word: c} of all words from some count on, at most ``most`` of them. The
    count is found from a table of the counts' logarithms (a few hundred rows)."""
    step = F.floor(F.ln("c") * 20).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        if total + row["count"] > most:
            break
        total, least = total + row["count"], row["step"]
    if least is None:
        return {}, 0
    found = counts.where(step >= least).collect()
    return {r.word.encode(): r.c for r in sorted(found, key=lambda r: (-r.c, r.word))}, total


def _encode(docs: DataFrame, symbol_of: dict[bytes, int], rare: int, end: int) -> DataFrame:
    """(row, doc_id, held_out, symbols, rare_words) of each document; row tells
    rows apart; symbols: 32-bit numbers, packed; rare_words: array of (word, n)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(symbol_of)
    schema = T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"], docs.schema["held_out"],
        T.StructField("symbols", T.BinaryType()),
        T.StructField("rare_words", T.ArrayType(T.StructType([
            T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())])))])
    rare_arrow = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = table.value.get, TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                symbols, names, numbers, places = [], [], [], [0]
                for x in part.column(2):
                    words = (x.as_py() or "").encode("utf-8").lower().split()
                    ids = np.fromiter((get(w, rare) for w in words), np.int32, len(words))
                    unknown = Counter(words[k] for k in np.flatnonzero(ids == rare).tolist())
                    symbols.append(np.append(ids, np.int32(end)).tobytes())
                    names += [w.decode() for w in unknown]
                    numbers += unknown.values()
                    places.append(len(names))
                structs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32())],
                                                     names=["word", "n"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + part.num_rows)), part.column(0), part.column(1),
                    pa.array(symbols, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(places, pa.int32()), structs).cast(rare_arrow)],
                    names=schema.names)
                row += part.num_rows

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _sequences(column: pa.BinaryArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in column]


def _pass(encoded: DataFrame, model: Model, overall: np.ndarray) -> Model:
    """One Baum-Welch pass over all training documents: counts are summed
    within each partition, then over partitions by symbol."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)
    states, symbols = len(model.start), len(model.emit)
    names = [f"s{k}" for k in range(states)]
    schema = "kind int, symbol int, " + ", ".join(f"{c} double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Expected.zero(symbols, states)
        for b in batches:
            texts = [stretches(x) for x in _sequences(b.column(0))]
            opens = np.array([k == 0 for parts in texts for k in range(len(parts))], bool)
            expected_counts(shared.value, [p for parts in texts for p in parts], opens, counts)
        used = np.flatnonzero(counts.emit.any(1))
        kinds = np.r_[np.zeros(len(used)), np.ones(states), [2]].astype(np.int32)
        number = np.r_[used, np.arange(states), [0]].astype(np.int32)
        values = np.concatenate([counts.emit[used], counts.move, counts.start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(number), *(pa.array(c) for c in values.T)],
                                         names=["kind", "symbol", *names])

    rows = encoded.where(~F.col("held_out")).select("symbols").mapInArrow(run, schema)
    sums = rows.groupBy("kind", "symbol").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    shared.destroy()
    counts = Expected.zero(symbols, states)
    for kind, into in ((0, counts.emit), (1, counts.move), (2, counts.start[None])):
        part = sums[sums["kind"] == kind]
        into[part["symbol"].to_numpy()] = part[names].to_numpy()
    return re_estimated(counts, overall)


def seed_model(overall: np.ndarray, states: int) -> Model:
    """The model before the first pass: emissions that differ from the overall
    frequencies by fixed random factors, and states that mostly stay."""
    emit = overall[:, None] * np.random.default_rng(7).gamma(2.0, size=(len(overall), states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
                    vocabulary: int = VOCABULARY, passes: int = PASSES) -> DataFrame:
    """For every row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10 probabilities of the whole text).

    Null texts count as empty (one token, END). Repeated rows count each time
    and are scored each; null ids are trained on or held out as the empty text
    is; without training documents all words are unseen (base score 0 for END
    alone); an empty table gives no rows; other columns are not read."""
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"),
                       docs[text_col].cast("string").alias("text"))
    counts = stored(word_counts(rows), "word-counts")
    trained = rows.where(~F.col("held_out")).count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + trained, kinds + (trained > 0)
    below = total + SMOOTHING * (kinds + 1)
    frequent, _ = frequent_words(counts, vocabulary)
    rare, end = len(frequent), len(frequent) + 1
    overall = np.array([*frequent.values(), 0, trained], float) + SMOOTHING
    overall[rare] = max(below - overall.sum() + SMOOTHING, SMOOTHING)  # all other words, the unseen one among them
    overall /= below
    encoded = stored(_encode(rows, {w: k for k, w in enumerate(frequent)}, rare, end), "symbols")
    shares = overall / overall.sum()
    model = seed_model(shares, states)
    for _ in range(passes if trained else 0):
        model = _pass(encoded, model, shares)
    known = np.array([*(c > 0 for c in frequent.values()), False, trained > 0])
    scored = _scored(encoded, model, np.log10(overall), known, rare)
    return _with_rare(scored, encoded, counts, below, float(math.log10(overall[rare])), total)


def _scored(encoded: DataFrame, model: Model, base: np.ndarray, known: np.ndarray, rare: int) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast((model, base, known))
    id_field = encoded.schema["doc_id"]
    schema = T.StructType([T.StructField("row", T.LongType()), id_field, T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("forward", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base, known = shared.value
        common = base.copy()
        common[rare] = 0.0  # rare words add their own part
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                texts = _sequences(part.column(3))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in texts], pa.int64()),
                    pa.array([int(known[s].sum()) for s in texts], pa.int64()),
                    pa.array([float(common[s].sum()) for s in texts]), pa.array(log10_likelihood(model, texts))],
                    names=schema.names)

    return encoded.select("row", "doc_id", "held_out", "symbols").mapInArrow(run, schema)


def _with_rare(scored: DataFrame, encoded: DataFrame, counts: DataFrame, below: float, log_rare: float,
               total: int) -> DataFrame:
    """Add what rare words contribute: their counts come by a join on the word
    (few rows a word, as frequent words are not among them)."""
    each = encoded.select("row", F.explode("rare_words").alias("w")).select("row", "w.word", "w.n")
    log_base = F.log10((F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING)) / F.lit(below))
    sums = each.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * log_base).alias("rare_base"), F.sum("n").alias("rare_n"))
    none = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (F.col("forward") + F.coalesce("rare_base", none) - F.coalesce("rare_n", F.lit(0)) * F.lit(log_rare)).alias("score"))
