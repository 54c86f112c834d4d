"""Nothing outside of the folder imports it."""

import glob
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_the_library_does_not_import_the_folder():
    for f in glob.glob(f"{ROOT}/quillspark/**/*.py", recursive=True) + glob.glob(f"{ROOT}/tests/*.py"):
        if f"{os.sep}llm{os.sep}" not in f:
            assert not re.search(r"import.*\bllm\b|\bllm\b.*import|quillspark\.llm", open(f).read()), f


def test_one_query_for_each_operator():
    from quillspark.llm import queries

    names = [n for n in queries.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
