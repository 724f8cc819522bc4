"""A factor's messages against the sums written out."""

import itertools
import math
import random

import pandas as pd

from hornfels.operators import inference as I


def test_messages_of_a_factor_are_its_sums():
    rng = random.Random(2)
    values, picks, m = [], [], [rng.random() for _ in range(6)]  # three variables of two states
    for states in itertools.product(range(2), repeat=3):
        values.append(rng.random())
        picks += [2 * k + s for k, s in enumerate(states)]
    values.append(0.5)  # an entry over the first variable only
    picks += [1, -1, -1]
    rows = [(v, picks[3 * i : 3 * i + 3]) for i, v in enumerate(values)]
    for maximum in (False, True):
        got = I._sent(pd.Series([values]), pd.Series([picks]), pd.Series([m]), maximum)[0]
        for slot in range(6):
            terms = [v * math.prod(m[q] for q in p if q not in (slot, -1)) for v, p in rows if slot in p]
            assert math.isclose(got[slot], max(terms) if maximum else sum(terms))
