import subprocess
import sys

from conftest import ROOT


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries().keys() >= e.oracle_sql().keys() and e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_broken_subpackage_is_not_passed_over(tmp_path):
    """Only a missing subpackage is left out; an error within one shows."""
    import os
    import shutil

    for name in ("__spark_entry__.py", "tidelog"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    llm = tmp_path / "tidelog" / "llm"
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True).returncode
    if llm.exists():
        (llm / "queries.py").write_text("import no_such_module\n")
        assert run() != 0
        shutil.rmtree(llm)
    assert run() == 0
