"""The whole suite must be collected, with and without further test folders beside this one."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def collected(*paths):
    run = subprocess.run(
        [sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", *paths],
        cwd=os.path.dirname(HERE), capture_output=True, text=True, timeout=300,
    )
    return run.returncode, run.stdout


def test_every_file_is_collected():
    code, out = collected("tests")
    assert code == 0, out[-2000:]
    for name in os.listdir(HERE):
        if name.startswith("test_"):
            assert f"tests/{name}::" in out


def test_each_file_is_collected_alone():
    code, out = collected("tests/test_access.py")
    assert code == 0, out[-2000:]
