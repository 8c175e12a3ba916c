import random

import numpy as np
import pytest

from tapewright.operators.features import RECURSIONS
from tapewright.operators.lockstep import lockstep_scan, run_block


def plain(closes, ranges):
    """The recursions of one series, a row at a time."""
    out, e, gain, loss, atr = [], {}, 0, 0, 0
    for n, (c, r) in enumerate(zip(closes, ranges, strict=True), 1):
        row = {}
        for k in (20, 50):
            a = 2.0 / (k + 1)
            e[k] = e.get(k, 0) + c if n < k else (e[k] + c) / k if n == k else a * c + (1.0 - a) * e[k]
            row[f"EMA_{k}"] = e[k] if n >= k else None
        if n > 1:
            up, down = max(c - closes[n - 2], 0), max(closes[n - 2] - c, 0)
            gain, loss = (gain + up, loss + down) if n <= 15 else ((gain * 13.0 + up) / 14.0, (loss * 13.0 + down) / 14.0)
            if n == 15:
                gain, loss = gain / 14, loss / 14
        row["RSI_14"] = None if n < 15 else (50.0 if gain == 0 else 100.0) if loss == 0 else 0.0 if gain == 0 else 100.0 - 100.0 / (1.0 + gain / loss)
        atr = atr + r if n < 14 else (atr + r) / 14 if n == 14 else (atr * 13.0 + r) / 14.0
        row["ATR_14"] = atr if n >= 14 else None
        out.append(row)
    return out


def histories():
    """Lengths from one row to many; one of flat prices, one that only falls."""
    r = random.Random(1)
    lengths = [1, 2, 13, 14, 15, 16, 19, 20, 49, 50, 51, 300, 70, 1]
    made = {i: [(r.randint(10**6, 10**7), r.randint(0, 10**5)) for _ in range(n)] for i, n in enumerate(lengths)}
    return made | {100: [(500, 0)] * 40, 101: [(10**6 - i, 1) for i in range(40)]}


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 17])
def test_series_of_any_length_in_blocks_of_any_size(spark, block_rows):
    rows = [(k, i, c, t) for k, h in histories().items() for i, (c, t) in enumerate(h)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "series long, session int, close long, true_range long")
    got = {(r.series, r.session): r for r in lockstep_scan(frame, ["series"], ["session"], ["close", "true_range"], RECURSIONS, block_rows).collect()}
    assert len(got) == len(rows)
    for k, h in histories().items():
        for i, want in enumerate(plain(*zip(*h, strict=True))):
            assert {name: got[k, i][name] for name in RECURSIONS} == want  # to the last bit


def test_state_goes_on_in_the_next_block():
    h = histories()[11]
    close, spread = (np.array(c, float) for c in zip(*h, strict=True))
    carried, parts = {name: [0.0] * width for name, (width, _) in RECURSIONS.items()}, []
    for a, b in ((0, 10), (10, 17), (17, 120), (120, 300)):
        parts.append(run_block(np.arange(a + 1, b + 1), [close[a:b], spread[a:b]], RECURSIONS, carried))
    whole = run_block(np.arange(1, 301), [close, spread], RECURSIONS, {name: [0.0] * width for name, (width, _) in RECURSIONS.items()})
    for name in RECURSIONS:
        assert np.array_equal(np.concatenate([p[name] for p in parts]), whole[name], equal_nan=True)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "series long, session int, close long, true_range long")
    assert lockstep_scan(frame, ["series"], ["session"], ["close", "true_range"], RECURSIONS).count() == 0
