import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_twin_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_core_imports_nothing_of_llm():
    for path in (ROOT / "ionloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"ionloom\.llm|from \.+llm", path.read_text()), path


def test_entry_works_without_llm():
    code = "import sys; sys.modules['ionloom.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p4_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
