"""Ids of many words at once: repeated, long and forgotten words, each distinct word encoded once."""

import numpy as np
import pytest

from gridloom.llm.words import WordIds


@pytest.mark.parametrize("remembered", [0, 5, 1000])
def test_word_ids(remembered):
    asked = []
    ids_of = lambda w: asked.append(w) or list(w.encode()[:3]) + [len(w)]
    tool = WordIds(ids_of, lambda t: t.split("_"), np.uint16, remembered)
    tool.split = lambda t: [w + "_" for w in t.split("_")[:-1]]
    long = "x" * 40 + "_"
    calls = [["a_b_a_", "b_" + long + long], ["", "c_a_" + long + "é_c_"], [long + "y" * 30 + "_b_", "é_é_"], [""]]
    for texts in calls:
        asked.clear()
        got = tool.encode(texts)
        assert [x.tolist() for x in got] == [[i for w in tool.split(t) for i in list(w.encode()[:3]) + [len(w)]] for t in texts]
        assert len(asked) == len(set(asked))
    if remembered == 1000:
        asked.clear()
        tool.encode([t for texts in calls for t in texts])
        assert not asked
