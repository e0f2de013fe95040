import subprocess
import sys
from pathlib import Path


def test_a_missing_module_fails_loudly():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent.parent, capture_output=True, text=True)
    assert got.returncode != 0 and "regex" in got.stderr
