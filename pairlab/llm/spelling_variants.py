"""Spelling variants of words by a relational trie frontier.

The words' prefixes are the nodes of a trie, kept as a distributed edge table
(depth, node, label, child, ends). States (word, position, node, edits) walk it
level by level: a state that has used its edit follows the edge with the next
letters of its word (an equi-join on node and label); a state without an edit
stands on its own word's prefix and branches into the edges one replaced or
skipped letter away. A state that has read its whole word on an edge that ends
a word has found a neighbour.

Every word walks twice, as it stands and reversed (two tries in one table), and
starts on its own prefix of half its length: one edit leaves one half as it is.
So no state branches near the root, where every letter follows every other.
Edges have one letter up to depth 24, then lengths that double, so a word of n
letters takes about 24 + log2(n) levels. Node ids are 64-bit hashes of prefixes;
a clash could only add states, and every pair found is checked by its distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.exact_dedup import normalised
from pairlab.llm.storage import stored

MIN_LENGTH = 7
MIN_COUNT = 2
#: A near word is a word's form if it is this many times as frequent.
RATIO = 10
#: Depth up to which edges have one letter.
SINGLE = 24


def next_depth(depth: int) -> int:
    return depth + 1 if depth < SINGLE else 2 * depth - SINGLE + 4


def depths(first: int, longest: int) -> list[int]:
    """The depths at which nodes stand, below ``longest``."""
    found = [first]
    while next_depth(found[-1]) < longest:
        found.append(next_depth(found[-1]))
    return found


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                 min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters, A-Z lower-cased, one letter lost where
    the crc32 of ``id:run`` is divisible by 31 (at its remainder by the run's
    length). Counted with partial sums, so a frequent word is no hot key."""
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        normalised(docs[text_col].cast("string")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))).alias("run"))
    lot = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (lot % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(lot % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def _node(path: Column, back: Column) -> Column:
    return F.xxhash64(path, back)


def _walkers(words: DataFrame) -> DataFrame:
    """(path, back, chars, half): each word as it stands and reversed; half:
    the letters that stay as they are when the edit lies behind them."""
    chars, half = F.char_length("word"), F.floor(F.char_length("word") / 2).cast("int")
    return words.select(F.explode(F.array(
        F.struct(F.col("word").alias("path"), F.lit(False).alias("back"), chars.alias("chars"), half.alias("half")),
        F.struct(F.reverse("word").alias("path"), F.lit(True).alias("back"), chars.alias("chars"),
                 F.greatest(F.lit(1), F.least(chars - half, chars - 2)).alias("half")))).alias("w")).select("w.*")


def _slice(start: Column, length: Column | int) -> Column:
    """Letters of path after the first ``start``."""
    return F.substring("path", start + 1, length if isinstance(length, Column) else F.lit(length))


def edge_table(walkers: DataFrame, levels: list[int]) -> DataFrame:
    """(depth, node, label, child, ends) of both tries; ends: an edge's child is
    a whole word. One row an edge, merged before and after the shuffle."""
    steps = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(next_depth(d) - d).alias("length")) for d in levels])
    steps = F.filter(steps, lambda x: x["depth"] < F.col("chars"))
    each = walkers.select("path", "back", "chars", F.explode(steps).alias("s")).select("path", "back", "chars", "s.*")
    upto = F.least(F.col("depth") + F.col("length"), F.col("chars"))
    each = each.select("depth", _node(F.substring("path", F.lit(1), F.col("depth")), F.col("back")).alias("node"),
                       _slice(F.col("depth"), F.col("length")).alias("label"),
                       _node(F.substring("path", F.lit(1), upto), F.col("back")).alias("child"),
                       (upto == F.col("chars")).alias("ends"))
    return each.groupBy("depth", "node", "label", "child").agg(F.max("ends").alias("ends"))


def _advance(frontier: DataFrame, own: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """States one level down. ``frontier`` has used its edit and follows the
    edge that its word goes on with; ``own`` (no edit) branches."""
    exact = frontier.withColumn("label", _slice(F.col("pos"), length)).join(edges, ["node", "label"]).select(
        "path", "back", "chars", (F.col("pos") + F.char_length("label")).alias("pos"), "child", "ends")
    n = F.char_length("label")
    here, more = _slice(F.col("pos"), n), _slice(F.col("pos"), n + 1)
    # of two words that differ in one letter the smaller one (from this letter on) finds the other;
    # of two words of different lengths the longer one does
    replaced = F.when((F.col("label") > here) & (F.levenshtein(here, "label", 1) == 1) & (F.char_length(here) == n),
                      F.col("pos") + n)
    skipped = F.when(((F.col("label") != here) | (F.col("pos") + n + 1 == F.col("chars")))
                     & (F.char_length(more) == n + 1) & (F.levenshtein(more, "label", 1) == 1), F.col("pos") + n + 1)
    branched = own.join(edges, "node").select(
        "path", "back", "chars", F.explode(F.array_compact(F.array(replaced, skipped))).alias("pos"), "child", "ends")
    return exact.unionByName(branched)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words (distinct strings in column
    word) that differ by exactly one inserted, deleted or replaced letter.
    Words need two letters at least; an empty table gives no pairs. Each level
    is written to shared storage and read again."""
    walkers = _walkers(words.select("word"))
    bounds = walkers.agg(F.min("half"), F.max("chars")).first()
    if bounds[0] is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    levels = depths(max(1, min(bounds[0], SINGLE)), bounds[1])
    edges = stored(edge_table(walkers, levels), "trie-edges")
    frontier, found = None, None
    for depth in levels:
        # a word enters at the last level within its first half
        own = walkers.where((F.col("chars") > depth) & (F.col("half") < next_depth(depth))).select(
            "path", "back", "chars", F.lit(depth).alias("pos"),
            _node(F.substring("path", 1, depth), F.col("back")).alias("node"))
        waiting = own.limit(0) if frontier is None else frontier
        below = edges.where(F.col("depth") == depth).drop("depth")
        states = stored(_advance(waiting, own, below, next_depth(depth) - depth), "frontier")
        ended = states.where((F.col("pos") == F.col("chars")) & F.col("ends")).select("path", "back", "child")
        found = ended if found is None else found.unionByName(ended)
        frontier = states.where(F.col("pos") < F.col("chars")).select(
            "path", "back", "chars", "pos", F.col("child").alias("node"))
    ends = walkers.select(_node(F.col("path"), F.col("back")).alias("child"), F.col("path").alias("other"))
    pairs = found.join(ends, "child").where(F.levenshtein("path", "other", 1) == 1).select(
        F.when(F.col("back"), F.reverse("path")).otherwise(F.col("path")).alias("word"),
        F.when(F.col("back"), F.reverse("other")).otherwise(F.col("other")).alias("near"))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form), form never null and no cycles: the
    last word reached by following forms. Each round doubles the step, so the
    rounds are the logarithm of the longest chain."""
    state = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = stored(state.join(ahead, "root", "left"), "roots")
        state = joined.select("word", F.coalesce("ahead", "root").alias("root"))
        if joined.where("ahead IS NOT NULL").isEmpty():
            return state


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row a word: word, form, root string; n, n_near, form_n long.

    Null texts have no words; a null id counts as the empty text; repeated rows
    count each time; very long words take more levels, not more branches; an
    empty table or one without words gives no rows; other columns are not read.
    Equal n: the near word that is smaller in code-point order is the form."""
    words = stored(corpus_words(docs, id_col, text_col, min_length, min_count), "words")
    pairs = stored(near_words(words), "near-words")
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"),
                                       F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(is_form, F.col("best.near")).alias("form"),
                                F.when(is_form, -F.col("best.less")).alias("form_n")), "variants")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                  "n_near", "form_n")
