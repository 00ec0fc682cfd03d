"""The entry points work with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(tmp_path):
    (tmp_path / "lodestone").mkdir()
    for p in (ROOT / "lodestone").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "lodestone" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; m.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
