"""Parser corpus for the tolerant annotation cascade."""

from pyspark.sql import functions as F

from pairlab.functions.parse import extract_annotation, strict_annotation

CORPUS = [
    ('{"complex": [1, 5], "motivi": {"1": "a"}}', "ok", [1, 5], {"1": "a"}),
    ("{'complex': [1, 5], 'motivi': {'1': 'a'}}", "ok", [1, 5], {"1": "a"}),
    ('Ecco: {"complex": [1], "motivi": {"1": "a"}}}}', "ok", [1], {"1": "a"}),
    ('{"complex": [1, 5, nota: vedi 0], "motivi": {"1": "a", "7": "b", "1": "c"}}', "recovered_regex", [0, 1, 5], {"1": "c"}),
    ('{"motivi": {"1": "a"}}', "ok", [], {"1": "a"}),
    ('{"complex": [2, 2, 9, 3]}', "ok", [2, 3], {}),
    ('{"complex": "abc"}', "unparsable", None, None),
    ("   ", "empty", None, None),
    (None, "empty", None, None),
    ("Non so rispondere.", "unparsable", None, None),
    ('{"a": 1} {"complex": [2], "motivi": {"2": "x"}}', "recovered_regex", [2], {"2": "x"}),
    ('{"complex": [3], "complex": [1]}', "ok", [1], {}),
    ('{"complex": [1], "motivi": {"1": "a", "1": "b"}}', "ok", [1], {"1": "b"}),
    ('{"complex": [1, "2"], "motivi": {"1": "usa { qui"}}', "ok", [1, 2], {"1": "usa { qui"}),
    ('{"complex": "[1, 2]"}', "recovered_regex", [1, 2], {}),
    ('{"complex": null}', "unparsable", None, None),
    ('{"complex": [1, 2.5]}', "recovered_regex", [1, 2, 5], {}),
    ('{"complex": [4], "motivi": {"4": "a"}} "}', "ok", [4], {"4": "a"}),
    ('{"complex": [4], "motivi": {"4": "tronca', "recovered_regex", [4], {}),
    ('{"complex": [4]} nota } fine }', "ok", [4], {}),
]


def test_cascade(spark):
    df = spark.createDataFrame([(c[0],) for c in CORPUS], "s string")
    got = df.select(extract_annotation(F.col("s"), F.lit(6)).alias("a")).collect()
    for (raw, status, cx, mt), r in zip(CORPUS, got):
        assert r["a"]["status"] == status, raw
        assert (list(r["a"]["complex"]) if r["a"]["complex"] is not None else None) == cx, raw
        if mt is not None:
            assert dict(r["a"]["motivi"]) == mt, raw


def test_strict_parser(spark):
    rows = [('```json\n{"complex": [2, 3, 9]}\n```',), ("{'complex': [1]}",), ('{"complex": [1.5, 2]}',),
            ('{"complex": ["1", 2]}',), ('{"complex":[1]} {}',), ('{"complex":[1],"motivi":{"1":"usa { qui"}}',),
            ('{"complex": [3], "complex": [1]}',), ('{"complex": [1',), ('{"motivi": {}}',), (None,), ("",)]
    df = spark.createDataFrame(rows, "s string")
    got = [list(r[0]) for r in df.select(strict_annotation("s", F.lit(6))).collect()]
    assert got == [[2, 3], [], [2], [2], [], [1], [1], [], [], [], []]


def test_each_path_is_worked_out_once(spark):
    df = spark.createDataFrame([("Ecco: {'complex': [1, 9], 'motivi': {'2': 'x'}}}}", 5)], "r string, n int").select(
        extract_annotation("r", "n").alias("a"))
    found = df._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("regexp_extract_all") == 3
