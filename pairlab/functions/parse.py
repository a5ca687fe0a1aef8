"""Tolerant parsing of model annotations (G17-G23, F4) as column expressions.

Cascade per response, with n = number of tokens of its sentence:
  blank                                   -> status "empty"
  blob = first '{' .. last '}' (else the whole text)
  JSON path: the blob is one JSON object and nothing else, as it stands or
    mended (single-quoted strings, spurious quotes and braces at the end, text
    after the last balanced brace); "complex" is missing or a list whose items
    are all integers or integer strings; of repeated keys the last one counts
                                          -> status "ok"; indices in [0, n),
                                             sorted, unique; reasons as given
  regex path: integers inside `complex: [...]` (else anywhere in the blob) and
    `"i": "text"` reason pairs (mixed quotes, last duplicate wins), both range
    checked; indices found only in reasons are added
                                          -> "recovered_regex" if anything found,
                                             else "unparsable"
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the cascade.
COMPLEX_LIST = r'(?s)"?complex"?\s*:\s*\[(.*?)\]'
INTEGER = r"\b\d+\b"
REASONS_REGION = r'(?s)"?motivi"?\s*:\s*\{(.*)\}'
REASON_PAIR = r"""(?s)["'](\d+)["']\s*:\s*(["'])(.*?)\2"""
INT_LIKE = r"^\s*-?\d+\s*$"
SINGLE_QUOTED = r"(?<=[:\{\[,\s])'([^']*?)'(?=[\}\]:,\s])"
SPURIOUS_END = r"""[}"'\s]+$"""
#: The JSON reader takes double quotes only.
STRICT = {"allowSingleQuotes": "false"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def isolate_blob(raw) -> Column:
    """Text from the first '{' to the last '}', else the whole text."""
    r = _c(raw)
    s = F.locate("{", r)
    e_rev = F.locate("}", F.reverse(r))
    e = F.length(r) - e_rev + 1
    return F.when((s > 0) & (e_rev > 0) & (e > s), r.substr(s, e - s + 1)).otherwise(r)


def _in_range(arr: Column, n: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(arr, lambda i: (i >= 0) & (i < n))))


def _ints(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.trim(x).try_cast("bigint"))


def last_wins_map(keys: Column, values: Column) -> Column:
    """map_from_arrays keeping the last value of duplicate keys."""
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
                                                     lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _object(text: Column, kind: str) -> Column:
    """A text that is one JSON object and nothing else as ``kind``, else null
    (between brackets, the reader refuses whatever follows the object)."""
    whole = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", STRICT)
    return F.when(text.startswith("{") & (F.size(whole) == 1), F.get(whole, 0))


def _to_last_balance(text: Column) -> Column:
    """``text`` up to the last closing brace at which none is open."""
    pieces = F.split(text, r"\}")
    ends = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(0).alias("open"), F.lit(0).alias("at"), F.lit(0).alias("last")),
        lambda acc, p: _let(F.struct(
            (acc["open"] + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))) - 1).alias("open"),
            (acc["at"] + F.length(p) + 1).alias("at")), lambda now: F.struct(
                now["open"].alias("open"), now["at"].alias("at"),
                F.when(now["open"] == 0, now["at"]).otherwise(acc["last"]).alias("last"))))
    return _let(ends["last"], lambda e: F.when(e > 0, F.substring(text, F.lit(1), e)).otherwise(text))


def _json_object(blob: Column) -> Column:
    """struct<text, entries> of the first form of the blob that is a JSON object: as it
    stands, then mended. No mending gives a text another beginning, so one that does
    not begin with a brace has no such form; forms equal to an earlier one are passed over."""
    def form(text: Column) -> Column:
        return _let(text, lambda t: _let(_object(t, "map<string,string>"), lambda m: F.when(
            m.isNotNull(), F.struct(t.alias("text"), F.map_entries(m).alias("entries")))))

    def first(b: Column, quoted: Column) -> Column:
        mend = (lambda t: t, lambda t: F.regexp_replace(t, SPURIOUS_END, "}"), _to_last_balance)
        return F.coalesce(*[x for m in mend for x in (form(m(b)), F.when(quoted != b, form(m(quoted))))])

    return _let(blob, lambda b: F.when(b.startswith("{"), _let(F.regexp_replace(b, SINGLE_QUOTED, '"$1"'), lambda q: first(b, q))))


def _list_items(text: Column) -> Column:
    """Items of the (last) "complex" of a JSON object as variants; null if it is not a list."""
    return F.try_variant_get(_object(text, "struct<complex: variant>")["complex"], "$", "array<variant>")


def _is_integer(item: Column) -> Column:
    return F.schema_of_variant(item) == "BIGINT"


def _item_text(item: Column) -> Column:
    return F.try_variant_get(item, "$", "string")


def _last_value(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def _parsed_json(found: Column, n: Column) -> Column:
    """struct<ok, complex, motivi> of a JSON object (see ``_json_object``)."""
    def read(entries: Column, items: Column) -> Column:
        listed = F.forall(items, lambda x: F.coalesce(
            _is_integer(x) | ((F.schema_of_variant(x) == "STRING") & _item_text(x).rlike(INT_LIKE)), F.lit(False)))
        missing = ~F.exists(entries, lambda e: e["key"] == "complex")
        indices = _in_range(F.transform(items, lambda x: _item_text(x).try_cast("bigint")), n)
        reasons = _last_value(entries, "motivi")
        given = _let(F.when(reasons.startswith("{"), F.from_json(reasons, "map<string,string>", STRICT)),
                     lambda m: last_wins_map(F.map_keys(m), F.map_values(m)))
        return F.struct(F.coalesce(missing | listed, F.lit(False)).alias("ok"),
                        F.when(missing, F.array().cast("array<bigint>")).otherwise(indices).alias("complex"),
                        F.coalesce(given, F.create_map().cast("map<string,string>")).alias("motivi"))

    return _let(found, lambda o: _let(_list_items(o["text"]), lambda items: read(o["entries"], items)))


def _parsed_by_rules(blob: Column, n: Column) -> Column:
    """struct<complex, motivi, found> of the regex path."""
    region = F.when(blob.rlike(COMPLEX_LIST), F.regexp_extract(blob, COMPLEX_LIST, 1)).otherwise(blob)
    rx_idx = _in_range(_ints(F.regexp_extract_all(region, F.lit(INTEGER), 0)), n)
    m_region = F.when(blob.rlike(REASONS_REGION), F.regexp_extract(blob, REASONS_REGION, 1)).otherwise(F.lit(""))

    def reasons(region: Column) -> Column:
        keys = F.regexp_extract_all(region, F.lit(REASON_PAIR), 1)
        vals = F.transform(F.regexp_extract_all(region, F.lit(REASON_PAIR), 3),
                           lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
        return F.filter(F.arrays_zip(keys.alias("k"), vals.alias("v")),
                        lambda e: (e["k"].try_cast("bigint") >= 0) & (e["k"].try_cast("bigint") < n))

    rx_motivi = _let(_let(m_region, reasons), lambda pairs: last_wins_map(
        F.transform(pairs, lambda e: e["k"]), F.transform(pairs, lambda e: e["v"])))
    return _let(rx_idx, lambda found: _let(rx_motivi, lambda m: F.struct(
        _in_range(F.array_union(found, _ints(F.map_keys(m))), n).alias("complex"), m.alias("motivi"),
        ((F.size(found) > 0) | (F.size(m) > 0)).alias("found"))))


def extract_annotation(raw, n) -> Column:
    """struct<complex array<bigint>, motivi map<string,string>, status string>."""
    raw, n = _c(raw), _c(n)
    empty = raw.isNull() | raw.rlike(r"^\s*$")
    nothing = (F.lit(None).cast("array<bigint>"), F.lit(None).cast("map<string,string>"))

    def result(status: str, complex_: Column, motivi: Column) -> Column:
        return F.struct(complex_.alias("complex"), motivi.alias("motivi"), F.lit(status).alias("status"))

    # each path is worked out once, the second only where the first found no annotation
    def by_rules(blob: Column) -> Column:
        return _let(_parsed_by_rules(blob, n), lambda x: F.when(
            x["found"], result("recovered_regex", x["complex"], x["motivi"])).otherwise(result("unparsable", *nothing)))

    def parse(blob: Column) -> Column:
        return _let(_parsed_json(_json_object(blob), n), lambda json: F.when(
            json["ok"], result("ok", json["complex"], json["motivi"])).otherwise(by_rules(blob)))

    return F.when(empty, result("empty", *nothing)).otherwise(_let(isolate_blob(raw), parse))


def strict_annotation(raw, n) -> Column:
    """G23 (older strict parser): strip code fences, take the text from the first
    '{' to the last '}', parse it strictly (one object in double quotes, no
    other text); integer items of ``complex`` in [0, n) are kept, strings are
    not; anything unparsable gives an empty list."""
    r = F.regexp_replace(F.trim(_c(raw)), r"(?m)^```(?:json)?|```$", "")
    blob = F.regexp_extract(F.trim(r), r"(?s)(\{.*\})", 1)
    ints = _let(blob, lambda b: F.transform(F.filter(_list_items(b), _is_integer), lambda x: F.try_variant_get(
        x, "$", "bigint")))
    return F.coalesce(F.filter(ints, lambda i: (i >= 0) & (i < _c(n))), F.array().cast("array<bigint>"))
