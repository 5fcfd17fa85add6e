import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_entry_works_without_the_curation_parts():
    code = (
        "import sys; sys.modules['tessaprobe.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert len(names) > 60 and 'pipeline' not in names and set(e.oracle_sql()) <= names, names"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "slope" in df.columns
