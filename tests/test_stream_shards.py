"""Many keys of a stream in one state: the shards against plain loops, and how often they call their state."""

import random
from types import SimpleNamespace

import pandas as pd

from folioflow.streaming import logs

MINUTE = 60_000_000
STATES = ["OK", "EMPTY", "RATE_LIMITED", "TIMEOUT"]


class Handle:
    """The state and the timers of one shard."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


def drive(processor, batches, names):
    """All rows told, and the most calls of the state in one batch; the watermark follows each batch."""
    handle, told, most, watermark = Handle(), [], 0, 0
    processor.init(handle)
    for rows in [*batches, []]:
        handle.asked = 0
        if rows:
            d = pd.DataFrame(rows, columns=names)
            told += processor.handleInputRows((7,), iter([d.iloc[::2], d.iloc[1::2]]), None)
            watermark = max(watermark, int(d["at"].max()) // 1000 - 3_600_000)
        else:
            watermark = 1 << 50
        for t in sorted(t for t in handle.timers if t < watermark):
            told += processor.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: t))
            handle.timers.discard(t)
        most = max(most, handle.asked)
    assert not handle.timers
    return pd.concat(told, ignore_index=True), most


def log(seed, keys, batches):
    """Batches of calls, each up to an hour behind the one before; some calls have no key, some share a time."""
    r, n, out = random.Random(seed), 0, []
    for i in range(batches):
        rows = []
        for _ in range(4 * keys):
            rows.append((r.choice([None, *range(keys)]), (100 + 90 * i + r.randrange(90)) * MINUTE - r.randrange(2) * 30 * MINUTE, n, r.choice(STATES)))
            n += 1
        out.append([(None if k is None else f"op{k}", *rest) for k, *rest in rows])
    return out


def test_first_attempts_of_many_keys():
    batches = log(1, 200, 6)
    got, most = drive(logs.FirstAttempt(), [[b[:3] for b in rows] for rows in batches], ["key", "at", "attempt_id"])
    want = {}
    for rows in batches:
        for k, at, i, _ in rows:
            if k is not None:
                want[k] = min(want.get(k, (at, i)), (at, i))
    assert sorted(zip(got["key"], got["attempt_id"])) == sorted((k, i) for k, (_, i) in want.items())
    assert most < 20


def test_a_key_that_was_told_is_not_told_again():
    rows = [[("a", 100 * MINUTE, 1), ("b", 500 * MINUTE, 2)], [("a", 90 * MINUTE, 3), ("a", 501 * MINUTE, 4)]]
    got, _ = drive(logs.FirstAttempt(), rows, ["key", "at", "attempt_id"])
    assert sorted(zip(got["key"], got["attempt_id"])) == [("a", 1), ("b", 2)]


def test_running_states_of_many_operations():
    batches, silence = log(2, 200, 6), 60 * MINUTE
    got, most = drive(logs.RunningState(3_600_000), batches, ["operation_id", "at", "attempt_id", "status"])
    state, silent = {}, []
    for rows in batches:
        for op, at, i, status in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1:3]):
            calls, *last = state.get(op, (0, None, None, None))
            if last[0] is None or (at, i) >= tuple(last[:2]):
                if last[2] in logs.DEGRADING and at - last[0] > silence:
                    silent.append((op, calls, last[0]))
                last = [at, i, status]
            state[op] = (calls + 1, *last)
    silent += [(op, calls, at) for op, (calls, at, _, status) in state.items() if status in logs.DEGRADING]
    told = got[got["silent"]]
    # told by the next call or by a timer before it: the same silences, counted alike
    assert sorted(zip(told["operation_id"], told["at"])) == sorted((op, at) for op, _, at in silent)
    assert set(told["status"]) == {logs.FAILED}
    last = got.sort_values(["calls", "silent"]).drop_duplicates("operation_id", keep="last")
    want = [(op, logs.FAILED if status in logs.DEGRADING else status, calls) for op, (calls, _, _, status) in state.items()]
    assert sorted(zip(last["operation_id"], last["status"], last["calls"])) == sorted(want)
    assert most < 20
