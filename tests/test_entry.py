"""The driver's entry can be read before there is a session, and every query has a name of its own."""

import subprocess
import sys
from pathlib import Path


def test_entry_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q), sorted(set(o) - set(q))"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
