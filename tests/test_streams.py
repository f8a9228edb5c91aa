"""The fact upsert's exchanges with its state."""

from pyspark.sql import Row

from palimpsest.config import DEFAULT
from palimpsest.streaming import facts as F


class State:
    """A value and a map that count what is asked of them."""

    def __init__(self):
        self.value, self.entries, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def containsKey(self, key):
        self.calls += 1
        return key in self.entries

    def updateValue(self, key, _):
        self.calls += 1
        self.entries.add(key)


def acted(state, predicate, statements):
    upsert = F.Upsert(DEFAULT)
    upsert.init(state)
    rows = [Row(id=i, subject=1, predicate=predicate, object=o, confidence=c, ts=i) for i, o, c in statements]
    return [r.action for r in upsert.handleInputRows((1, predicate), iter(rows[::-1]), None)]


def test_a_key_of_few_objects_costs_two_exchanges_a_batch():
    state = State()
    assert acted(state, "likes", [(1, "a", 0.1), (2, "b", 0.1), (3, "b", 0.9), (4, "a", 0.1), (5, None, 0.9), (6, "c", None)]) == ["created", "held", "coexist", "reinforced", "coexist", "coexist"]
    assert state.calls == 2
    assert acted(state, "likes", [(7, "b", 0.1), (8, "d", 0.1)]) == ["reinforced", "held"] and state.calls == 3
    single = State()
    assert acted(single, "view", [(1, "a", 0.5), (2, "a", 0.5), (3, "b", 0.1), (4, "b", 0.5)]) == ["created", "reinforced", "held", "superseded"] and single.calls == 2


def test_a_key_of_many_objects_looks_up_only_what_is_stated():
    state = State()
    assert acted(state, "likes", [(i, f"o{i}", 0.9) for i in range(200)])[1:] == ["coexist"] * 199
    before = state.calls
    assert acted(state, "likes", [(300, "o3", 0.1), (301, "o199", 0.1), (302, "new", 0.1)]) == ["reinforced", "reinforced", "held"]
    assert state.calls - before <= 3 and len(state.value[2]) <= F.FIRST
