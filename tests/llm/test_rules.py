"""Rules for the code of the operators."""

from __future__ import annotations

import pathlib
import re

from dnslens.llm import queries

ROOT = pathlib.Path(queries.__file__).resolve().parent
CODE = {p.name: p.read_text() for p in ROOT.glob("*.py")}


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES] == list(range(1, 14))
    assert set(queries.ORACLE_SQL) < set(queries.QUERIES)


def test_native_operators_use_built_in_functions_only():
    for name in ("fingerprints.py", "mixing.py"):
        for banned in ("pandas", "udf(", "mapIn", "applyIn", ".rdd", "numpy"):
            assert banned not in CODE[name], f"{name}: {banned}"


def test_nothing_unbounded_is_broadcast_or_gathered():
    for name, text in CODE.items():
        for banned in ("localCheckpoint", "crossJoin", "toPandas", "tempfile", "/tmp"):
            assert banned not in text, f"{name}: {banned}"
        assert len(re.findall(r"F\.broadcast\(", text)) == (name == "links.py")
        # A sample of a bounded number of rows, two numbers for each of a fixed number of ranges, codebooks.
        bounded = {"language.py": 2, "fingerprints.py": 1, "vector_codes.py": 3}
        assert text.count(".collect()") == bounded.get(name, 0), name


def test_the_library_does_not_import_the_operators():
    for path in ROOT.parent.rglob("*.py"):
        if path.parent != ROOT:
            assert not re.search(r"\bllm\b", path.read_text()), path
