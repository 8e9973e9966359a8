import os

import pytest

from millrace import session


@pytest.fixture
def left(monkeypatch):
    """Names of the intermediate results that are on disk when it is called."""
    made, fresh = {}, session.fresh_path

    def noted(spark, name):
        made[fresh(spark, name)] = name
        return list(made)[-1]

    monkeypatch.setattr(session, "fresh_path", noted)
    return lambda: sorted(name for path, name in made.items() if os.path.exists(path.removeprefix("file:")))
