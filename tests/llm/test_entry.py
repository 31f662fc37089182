"""The package is an addition: its queries come with it, and nothing else needs it."""

from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[2]


def test_queries_are_added():
    assert {"p1_percentiles", "p2_found", "p5_found", "p7_containers", "p8_found", "p9_found", "p3_found"} <= set(__spark_entry__.queries())


def test_nothing_else_imports_it():
    for path in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in [w for line in path.read_text().splitlines() if "import" in line for w in line.replace(".", " ").split()], path
