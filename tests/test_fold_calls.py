"""The scan of short groups takes many of them in one call, each by itself."""

import pandas as pd

from folioflow.operators import resolution as rs


def test_groups_of_one_call_are_apart():
    rows = pd.DataFrame({"q": [2, 1, 1, 2, 1], "rank": [0, 1, 0, 1, 2], "provider": "P", "external_id": list("abcde"), "keys": [["x"], ["x"], ["x", "y"], ["z"], ["w"]]})
    kept = rs._fold("q")(rows)
    assert list(zip(kept["q"], kept["external_id"])) == [(1, "c"), (1, "e"), (2, "a"), (2, "d")]
    none = rows.assign(q=None)
    assert list(rs._fold("q")(none)["external_id"]) == ["a", "d", "e"]
