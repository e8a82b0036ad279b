"""Rows of a video meet its state as arrays, without a frame for each video."""

import numpy as np
import pandas as pd

from strandline.streaming import modes as M


def test_held_rows_and_arrivals_in_order(monkeypatch):
    columns = ("time_ms", "id", "value")
    part = pd.DataFrame({"time_ms": [5, 1, 3], "id": [1, 2, 9], "value": [0.5, np.nan, 2.5]})
    empty = part.iloc[:0]

    def none(*args, **more):
        raise AssertionError("a frame was made")

    monkeypatch.setattr(M.pd, "concat", none)
    monkeypatch.setattr(M.pd, "DataFrame", none)
    t, i, v = M._ordered(iter([part, empty]), ([3, 4], [1, 7], [1.0, 1.5]), columns)
    assert t.tolist() == [1, 3, 3, 4, 5] and i.tolist() == [2, 1, 9, 7, 1] and v.tolist()[1:] == [1.0, 2.5, 1.5, 0.5] and np.isnan(v[0])
    assert [x.tolist() for x in M._ordered(iter([empty]), ([2, 1], [1, 1], [0.0, 1.0]), columns)] == [[1, 2], [1, 1], [1.0, 0.0]]
    assert [len(x) for x in M._ordered(iter([]), ([], [], []), columns)] == [0, 0, 0]
