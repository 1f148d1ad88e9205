"""The entry works without the optional queries, and a cluster without a shared folder is an error."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from quire.plans import scratch

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("missing", ["xxhash", "quire.llm", "corpus_pipeline"])
def test_entry_without_optional_parts(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert e.llm is None; print(len(e.queries()), len(e.oracle_sql()))"
    n, m = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(n) > 80 and int(m) > 75


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.ensure_checkpoints(session)
