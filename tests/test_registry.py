"""The registry does without the training-data operators."""

import importlib
import sys

import __spark_entry__


def test_entry_without_the_subpackage():
    held = {k: v for k, v in sys.modules.items() if k == "corpus_pipeline"}
    sys.modules["corpus_pipeline"] = None
    try:
        bare = importlib.reload(__spark_entry__)
        assert "feature_panel" in bare.queries() and not any(k.startswith("op") for k in bare.queries())
        assert "bars_build" in bare.oracle_sql()
    finally:
        del sys.modules["corpus_pipeline"]
        sys.modules.update(held)
        importlib.reload(__spark_entry__)
