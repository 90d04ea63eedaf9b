"""A writer killed at random: acknowledged writes are there, in an unbroken prefix."""

import os
import signal
import subprocess
import sys
import time

import pytest

from tidemark import Options, Table
from tidemark.torture import key, main, verify, write

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_killed_writer(spark, tmp_path):
    folder, last = f"file://{tmp_path}/t", 0
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.Popen([sys.executable, "-m", "tidemark.torture", "write", folder], cwd=ROOT, env=env, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
    try:
        began, acknowledged = time.time(), []
        while len(acknowledged) < 40 and time.time() - began < 120:
            line = run.stdout.readline().strip()
            if line.isdigit():
                acknowledged.append(int(line))
    finally:
        os.killpg(run.pid, signal.SIGKILL)
        run.wait()
    last = acknowledged[-1]
    with Table.open(spark, folder) as t:
        n = verify(t)
        assert n >= last + 1
        assert t.get(key(last)) == b"val:" + key(last)


def test_a_gap_is_told(spark, tmp_path):
    with Table.open(spark, f"file://{tmp_path}/t", Options(auto_compact=False)) as t:
        write(t, lambda n: None, 0, 5)
        assert verify(t) == 5
        t.delete(key(2))
        with pytest.raises(RuntimeError):
            verify(t)
    assert main(["frob"]) == 1
