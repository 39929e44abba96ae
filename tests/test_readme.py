import importlib
import os
import re

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_filters_of_the_coverage_table_exist():
    """A filter that the table names as an operator is one."""
    filters = importlib.import_module("quillstat.operators.filters")
    with open(README, encoding="utf-8") as f:
        named = re.findall(r"`(?:operators\.)?filters\.(\w+)", f.read())
    assert named and not [x for x in named if not hasattr(filters, x)]
