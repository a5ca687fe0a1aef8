"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an AND
of clauses, a clause an OR of alternatives, an alternative a set of trigrams
that must all occur. The index holds, for the trigrams that any rule asks for,
the documents they occur in (lower case, whole texts). Intersecting postings
gives each rule its candidates, and only those are verified with the regular
expression; a rule without mandatory trigrams scans every document."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that one stretch of a regular expression may expand to.
MAX_STRINGS = 64
#: Characters of a class that is still expanded.
MAX_CLASS = 8
#: Matches whose places are summed in one go.
SPAN_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` (syntax common to Java and Python) finds leftmost
    non-overlapping matches; those whose ``group`` has fewer than
    ``min_chars`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


#: Fixed rules. A run of hex digits or of key characters is maximal, so its
#: least length can stand in the pattern; an assignment's cannot, since a match
#: that is too short still uses up its text.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
         True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# -- trigram queries -------------------------------------------------------

def _strings(op, arg) -> list[str] | None:
    """All strings that a node can match, or None if they are too many."""
    if op is sre.LITERAL:
        return [chr(arg)]
    if op is sre.IN:
        out = []
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.append(chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < MAX_CLASS:
                out += map(chr, range(x[0], x[1] + 1))
            else:
                return None
        return out if len(out) <= MAX_CLASS else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else [s for x in each for s in x]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
        once = _sequence_strings(arg[2])
        return None if once is None else ["".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)]
    return None


def _sequence_strings(nodes) -> list[str] | None:
    out = [""]
    for op, arg in nodes:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = [a + b for a in out for b in more]
    return out


def trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[k:k + 3] for k in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses; each an OR of trigram sets. Empty: no mandatory trigrams."""
    clauses, run = [], [""]

    def close() -> None:
        sets = {trigrams(s) for s in run}
        least = [s for s in sets if not any(t < s for t in sets)]
        if least and all(least):
            clauses.append(sorted(least, key=sorted))
        run[:] = [""]

    for op, arg in sre_parser.parse(pattern):
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = [a + b for a in run for b in more]
            continue
        close()
        if more is not None and len(more) <= MAX_STRINGS:
            run = more
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            run = _sequence_strings(arg[2]) or [""]  # occurs once at least, then anything
            close()
        elif op is sre.SUBPATTERN:
            clauses += trigram_query_of(arg[3])
    close()
    return clauses


def trigram_query_of(nodes) -> list[list[frozenset[str]]]:
    """Clauses of a group's inside that could not be expanded as a whole."""
    strings = [_strings(op, arg) for op, arg in nodes]
    out = []
    for s in strings:
        sets = [trigrams(x) for x in s or [""]]
        if all(sets):
            out.append(sets)
    return out


def indexed_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for s in clause for t in s})


# -- index and candidates --------------------------------------------------

def postings(docs: DataFrame, wanted: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inverted index (trigram, doc_id) over whole texts, for ``wanted``."""
    low = docs.select(docs[id_col].alias("doc_id"), F.lower(docs[text_col].cast("string")).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("doc_id", F.explode(present).alias("trigram")).select("trigram", "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rules) with the positions of the indexed rules whose trigram
    query the document meets: postings joined with the queries' trigrams (a
    table as large as the rules), counted per alternative, then alternatives
    per clause and clauses per rule. A document's postings meet in partial
    counts before any shuffle."""
    terms, clauses = [], {}
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        clauses[r] = len(query)
        terms += [(r, c, a, len(s), t) for c, clause in enumerate(query) for a, s in enumerate(clause) for t in s]
    spark = docs.sparkSession
    table = spark.createDataFrame(terms, "rule int, clause int, alternative int, need int, trigram string")
    met = (postings(docs, indexed_trigrams(rules), id_col, text_col).distinct()
           .join(F.broadcast(table), "trigram")  # bounded by the rules
           .groupBy("doc_id", "rule", "clause", "alternative", "need").count().where("count = need")
           .groupBy("doc_id", "rule").agg(F.countDistinct("clause").alias("met")))
    full = F.create_map(*[F.lit(x) for pair in clauses.items() for x in pair])
    return (met.where(F.col("met") == full[F.col("rule")])
            .groupBy("doc_id").agg(F.collect_set("rule").alias("rules")))


# -- verification ----------------------------------------------------------

def _spans(text: Column, rule: Rule, position: int) -> Column:
    """array<struct<start, order, end>> of a rule's matches in code points.
    Places are sums over the lengths of the texts between the matches and of
    the matches, within blocks and then over blocks."""
    pattern = F.lit(rule.java)
    matched = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    between = F.transform(F.split(text, rule.java, -1), lambda s: F.length(s).cast("long"))
    passes = (F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g))
              if rule.group else matched)
    steps = F.zip_with(F.zip_with(matched, between, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), passes,
                       lambda s, g: F.struct(s["m"].alias("m"), s["b"].alias("b"), g.alias("g")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())
    none = F.array().cast("array<struct<start:long,order:int,end:long>>")
    zero = F.lit(0).cast("long")

    def in_block(begin: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("spans")), lambda acc, s: F.struct(
            (acc["at"] + s["b"] + s["m"]).alias("at"),
            F.when(s["g"] >= rule.min_chars, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + s["b"]).alias("start"), F.lit(position).alias("order"),
                (acc["at"] + s["b"] + s["m"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
            lambda acc: acc["spans"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SPAN_BLOCK).cast("int")),
                         lambda k: F.slice(steps, k * SPAN_BLOCK + 1, SPAN_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, s: a + s["b"] + s["m"]))
    begins = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.flatten(F.zip_with(F.slice(begins, F.lit(1), F.size(blocks)), blocks, in_block))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
                 keep: bool = False) -> DataFrame:
    """(doc_id, spans) for every row of ``docs``, or with ``keep`` its own
    columns and ``secret_spans``; spans: array of (start, order, end) by start,
    then by the rule's place in ``rules`` (order); code points, end exclusive.

    Null texts count as empty and have no spans; repeated rows give a row each;
    a null id is matched as an id like any other; candidates are found by id,
    so rows that share an id are all verified; an empty table gives no rows;
    columns of ``docs`` with clashing names stay as they are (one named
    secret_spans is replaced)."""
    found = candidates(docs, rules, id_col, text_col).withColumnRenamed("doc_id", "found_id")
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"),
                       *([F.struct("*").alias("row")] if keep else []))
    # the narrow side is hashed: no sort of texts
    joined = rows.join(found.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(found["found_id"]), "left")
    none = F.array().cast("array<struct<start:long,order:int,end:long>>")
    parts = []
    for r, rule in enumerate(rules):
        hit = F.col("t").rlike(rule.java)
        if trigram_query(rule.pattern):
            hit = F.coalesce(F.array_contains("rules", r), F.lit(False)) & hit
        parts.append(F.when(hit, _spans(F.col("t"), rule, r)).otherwise(none))
    spans = F.array_sort(F.concat(*parts))
    if keep:
        own = [c for c in docs.columns if c != "secret_spans"]
        return joined.select(*[F.col("row")[c].alias(c) for c in own], spans.alias("secret_spans"))
    return joined.select("doc_id", spans.alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
                   mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones joined) of its text replaced
    by ``mask``; n_chars, if there, follows the new text. Rows without spans,
    null texts among them, stay as they are."""
    found = scan_secrets(docs, rules, id_col, text_col, keep=True)
    text, spans = F.col(text_col), F.col("secret_spans")
    # a span begins a new cut if it starts after the end of all before it
    merged = F.aggregate(spans, F.array().cast("array<struct<start:long,end:long>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
        F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
            F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    starts = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), (s - e).cast("int")))
    out = F.when(F.size(spans) > 0, F.array_join(pieces, mask)).otherwise(text)
    changed = found.withColumn(text_col, out)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(
            F.size(spans) > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.drop("secret_spans")
