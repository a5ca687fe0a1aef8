"""E7/E8/B14 against a plain pandas statement of the same rules."""

import pandas as pd

from pairlab.operators.gating import gating_inputs
from pairlab.sources import fixtures

from conftest import SMALL


def _pandas_gating(pairs: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for oid, grp in pairs.sort_values("idx").groupby("original_sentence_idx"):
        gain = (grp["original_all"] - grp["simplification_all"]).round(9)
        valid = grp[gain > 0.05]
        if len(valid) == 0:
            continue
        gold = valid.loc[valid["simplification_all"].idxmin()]
        inputs = [(oid * 11 + 10, grp.iloc[0]["original_all"])]
        for _, r in valid.drop(gold.name).iterrows():
            inputs.append((oid * 11 + r["idx"] % 10, r["simplification_all"]))
        for gid, score in inputs:
            gap = score - gold["simplification_all"]
            rows.append((int(gid), round(gap, 9), int(round(gap, 9) > 0.10)))
    return pd.DataFrame(rows, columns=["gid", "gap", "label"]).sort_values("gid").reset_index(drop=True)


def test_gating_inputs_match_pandas(spark):
    p = fixtures.pair_table(spark, SMALL)
    want = _pandas_gating(p.toPandas())
    got = gating_inputs(p).select("gid", "gap_to_gold", "true_label").toPandas()
    got = got.assign(gap=got["gap_to_gold"].round(9)).sort_values("gid").reset_index(drop=True)
    assert list(got["gid"]) == list(want["gid"])
    assert list(got["true_label"]) == list(want["label"])
    assert (got["gap"] - want["gap"]).abs().max() < 1e-9
