"""Workers serve one stage after the other: what a task of the pipeline has let go of goes back to the machine."""

import pandas as pd
import pytest

from millrace.llm import common, decontam, simhash


def test_what_arrow_keeps_goes_back(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    common.give_back()
    assert pool.released == 1


@pytest.mark.parametrize(
    "module, make",
    [
        (simhash, lambda: simhash.fingerprint(None)),
        (simhash, lambda: simhash.shingle_set(None)),
        (simhash, lambda: simhash.prefixes(None, 5, 0.8, ([], []))),
        (decontam, lambda: decontam.held_items(None, decontam.Items([(1, "a b c")]))),
    ],
)
def test_functions_of_the_stages_give_back(monkeypatch, module, make):
    asked = []
    monkeypatch.setattr(module.F, "pandas_udf", lambda kind: lambda function: lambda column: function)
    monkeypatch.setattr(module, "give_back", lambda: asked.append(1))
    assert len(list(make()(iter([pd.Series(["a b c d e f g", None])])))) == 1
    assert asked == [1]
