"""Operators whose functions run in tasks, with executors that have no copy of the package."""

from tests.test_workers import run_apart

NAMES = ["op2_language_id", "op5_neighbours", "op7_packing", "op9_chat_format", "op10_token_counts", "op12_source_divergence", "op13_lexical_search"]


def test_operators(tmp_path):
    assert run_apart(NAMES, tmp_path) == NAMES
