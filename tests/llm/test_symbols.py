"""Symbols of op4's automata: two digits, also where a shard has more than 65,536 of them."""

import random

from contactry.llm.phrase_dedup import WINDOW, Automaton


def test_many_symbols_of_two_digits():
    rng = random.Random(1)
    passages = [b" ".join(b"%d" % rng.randrange(10**9) for _ in range(51)) for _ in range(1500)]
    automaton = Automaton()
    for i, passage in enumerate(passages):
        automaton.add(passage, (1 << 32) - 1, i)
    assert len(automaton.symbols) > 1 << 16 and {len(s) for s in automaton.symbols.values()} == {2}
    for i in (0, 700, 1400, 1499):
        assert automaton.places(passages[i], (i, 0)) == 0  # the first place of each
        assert automaton.places(passages[i], (i + 2000, 0)) == (1 << 32) - 1
        shifted = b" ".join([b"x", b"y", *passages[i].split()[:30]])
        assert automaton.places(shifted, (5000, 0)) == ((1 << (30 - WINDOW + 1)) - 1) << 2
