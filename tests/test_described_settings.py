"""Model queries ask for the described settings."""

from types import SimpleNamespace

from tarmac import presets
from tarmac.catalog import learning


def test_search_and_forest_run_as_described(monkeypatch):
    asked = {}
    prepared = SimpleNamespace(rows=SimpleNamespace(where=lambda _: None))
    monkeypatch.setattr(learning, "model_rows", lambda d: None)
    monkeypatch.setattr(learning.F, "col", lambda name: name)
    monkeypatch.setattr(learning.flows, "split_balance_scale", lambda *a, **k: prepared)
    monkeypatch.setattr(learning.models, "hyperparameter_search", lambda *a, **k: asked.update(search=k))
    monkeypatch.setattr(learning.models, "fit_forest", lambda *a, **k: asked.update(forest=k))
    monkeypatch.setattr(learning.flows, "train_and_evaluate", lambda rows, label, features, fitters: fitters["forest"](rows))
    learning._searched(None)
    learning.train_and_evaluate(None)
    assert asked["search"].get("trials", 60) == 60 and not asked["search"].get("overrides")
    assert asked["search"].get("space", presets.BOOSTED_SPACE) == presets.BOOSTED_SPACE
    assert asked["forest"] == {"trees": 200, "depth": 20}
