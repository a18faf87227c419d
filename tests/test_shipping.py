from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from lorekeep.session import build_session
from lorekeep.operators.recent_ring import recent_ring
spark = build_session("ship", "local[1]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"}})
rows = spark.createDataFrame([("k", i, h) for i, h in enumerate("aab")], "key string, seq bigint, hash string")
print("accepted", recent_ring(rows).rows.where("accepted").count())
"""


def test_workers_need_no_installed_package(tmp_path):
    """A driver that finds the package on its own path only, as on a cluster."""
    repo = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=repo)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "accepted 2" in done.stdout, done.stderr[-2000:]
