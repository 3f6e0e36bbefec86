"""The package's shape: nothing outside reads the training-data operators, and every query has a name and, mostly, its SQL."""

from pathlib import Path

from lodestrand.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


def test_only_the_entry_knows_the_training_data_operators():
    for path in (ROOT / "lodestrand").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_sql_belongs_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.oracle_sql()) > 0.8 * len(catalogue.queries())
