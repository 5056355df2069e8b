"""The rest of the library stands without the corpus operators."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    for path in ROOT.glob("kinetrace/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"kinetrace\.llm|corpus_pipeline", path.read_text()), path
