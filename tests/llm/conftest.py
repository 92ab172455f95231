import pytest


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    from codestrata.llm import op4_source_mix, op8_hilbert_shards

    monkeypatch.setattr(op4_source_mix, "RANGES", 6)
    monkeypatch.setattr(op8_hilbert_shards, "RANGES", 6)
