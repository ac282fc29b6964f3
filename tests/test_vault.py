"""Calls to the state of a vault entry."""

import pandas as pd

from veilgrain.streaming import streams


class _State:
    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, *_):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "update":
                self.value = args[0]
            return self.value if name == "get" else None

        return call


class _Fired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_vault_entry_takes_few_round_trips():
    state, processor = _State(), streams._VaultProcessor(10_000)
    processor.init(state)
    key = (1, "o", "v")
    made = list(processor.handleInputRows(key, iter([pd.DataFrame({"at": [35_000, 20_000]}), pd.DataFrame({"at": [20_005]})]), None))
    assert [tuple(r) for frame in made for r in frame.itertuples(index=False)] == [(*key, 20_000), (*key, 35_000)]
    assert state.calls == ["get", "update", "registerTimer"]
    assert list(processor.handleInputRows(key, iter([pd.DataFrame({"at": [44_999]})]), None)) == []
    assert state.calls[3:] == ["get"]
    processor.handleExpiredTimer(key, None, _Fired(44))
    processor.handleExpiredTimer(key, None, _Fired(45))
    assert state.calls[4:] == ["get", "get", "clear"]
