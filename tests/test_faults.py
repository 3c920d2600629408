"""Jobs survive lost tasks: a failed first attempt is retried and the results are
identical (deterministic order keys, no reliance on physical order)."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_SMOKE


def test_retried_task_gives_identical_results():
    script = os.path.join(os.path.dirname(__file__), "fault_run.py")
    out = subprocess.run([sys.executable, script, SF_SMOKE], capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")]
    assert line, out.stderr[-2000:]
    res = json.loads(line[-1])
    assert res["same"] and res["n"]["dedup"] > 0 and res["n"]["split"] == 100 and res["n"]["index"] == 200
    assert res["n"]["synthetic"] > 0
