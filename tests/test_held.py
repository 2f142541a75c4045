"""State of a stream in one batch: calls of a map go through a socket, so few of them are made."""

from stockline.streaming.fold import FEW, Held, Recent


class Counted:
    """A map in state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _called(self, value=None):
        self.calls += 1
        return value

    def getValue(self, key):
        return self._called(self.rows.get(key))

    def updateValue(self, key, value):
        self._called()
        self.rows[key] = value

    def removeKey(self, key):
        self._called()
        self.rows.pop(key, None)

    def iterator(self):
        return self._called(iter(self.rows.items()))

    def clear(self):
        self._called()
        self.rows.clear()


def test_a_new_session_of_few_calls_never_calls_the_map():
    state = Counted()
    known = Recent(state, None, None)
    for i in range(1000):
        if i % 50 == 0:
            known.clear()
        assert not known.containsKey((f"m{i}",))
        known.updateValue((f"m{i}",), (i,))
    known.flush()
    assert state.calls == 0 and len(known.recent) == 50 and not known.spilled


def test_many_keys_go_to_the_map_once_and_are_found_there():
    state, value = Counted(), ({}, False)
    for batch in range(4):
        known = Recent(state, *value)
        for i in range(batch * 40, batch * 40 + 40):
            assert known.getValue((f"m{i}",)) is None
            known.updateValue((f"m{i}",), (i,))
        known.flush()
        value = (known.recent, known.spilled)
        assert len(known.recent) <= FEW
    before = state.calls
    known = Recent(state, *value)
    assert [known.getValue((f"m{i}",)) for i in range(160)] == [(i,) for i in range(160)]
    known.updateValue(("m0",), (7,))
    known.flush()
    assert state.rows[("m0",)] == (7,) and state.calls - before <= 161
    known = Recent(state, known.recent, known.spilled)
    known.clear()
    known.updateValue(("m1",), (9,))
    known.flush()
    assert not state.rows and known.recent == {"m1": 9} and not known.spilled


def test_a_held_map_is_what_the_map_would_be():
    state = Counted()
    state.rows = {("a",): (1,), ("b",): (2,), ("c",): (3,)}
    held = Held(state)
    held.updateValue(("a",), (5,))
    held.removeKey(("b",))
    held.updateValue(("d",), (4,))
    assert list(held.iterator()) == [(("a",), (5,)), (("c",), (3,)), (("d",), (4,))]
    held.flush()
    assert state.rows == {("a",): (5,), ("c",): (3,), ("d",): (4,)}
    # all keys were changed and the map is known as a whole: what is stored still has to go
    for key in list(state.rows):
        held.updateValue(key, (0,))
    held.clear()
    held.updateValue(("z",), (1,))
    held.flush()
    assert state.rows == {("z",): (1,)}
