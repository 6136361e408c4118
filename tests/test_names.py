"""No module of the library defines a name twice: the second would hide the first without a word."""

import ast
import collections
import pathlib

import pytest

LIBRARY = sorted((pathlib.Path(__file__).resolve().parent.parent / "millrace").rglob("*.py"))


@pytest.mark.parametrize("path", LIBRARY, ids=lambda p: "/".join(p.parts[-2:]))
def test_no_name_is_defined_twice(path):
    body = ast.parse(path.read_text()).body
    names = collections.Counter(n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
    assert [n for n, count in names.items() if count > 1] == []
