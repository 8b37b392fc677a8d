import json
import os
import shutil
import subprocess
import sys
import tempfile
import time
from pathlib import Path

import pytest

from quarrymill.operators import runner

CHILDREN = """
import os, subprocess, sys, threading, time
seen = []
t = threading.Thread(target=lambda: seen.append(1)); t.start(); t.join()
p = subprocess.run([sys.executable, '-c', 'print(7)'], capture_output=True, text=True)
print(len(seen), p.stdout.strip())
if os.fork() == 0:
    os.setsid()
    if os.fork() == 0:
        time.sleep(3)
        open(%r, 'w')
    os._exit(0)
"""


@pytest.fixture(scope="module")
def readable():
    """A copy of the package that any user can read."""
    folder = tempfile.mkdtemp()
    os.chmod(folder, 0o755)
    shutil.copytree(os.path.dirname(os.path.dirname(os.path.abspath(runner.__file__))), f"{folder}/quarrymill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for at, folders, files in os.walk(folder):
        for name in (*folders, *files):
            os.chmod(os.path.join(at, name), 0o755)
    yield folder
    shutil.rmtree(folder)


def both_ways(readable: str, source: str, **how) -> list[dict]:
    """What run_script gives in this process and, as root, in one of another user that has more processes than a script may have."""
    out = [runner.run_script(source, **how)]
    if os.getuid() == 0:
        other = f"""
import json, os, subprocess, sys
os.setgroups([]); os.setgid(65534); os.setuid(65534)
held = [subprocess.Popen(['sleep', '60'], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) for _ in range(8)]
try:
    from quarrymill.operators import runner
    print(json.dumps(runner.run_script({source!r}, **{how!r})))
finally:
    for p in held: p.kill()
"""
        env = {"PATH": os.environ["PATH"], "PYTHONPATH": readable, "PYTHONDONTWRITEBYTECODE": "1"}
        own = f"{sys.prefix}/bin/python3"  # sys.executable may lie in a folder of root's
        done = subprocess.run([own, "-c", other], capture_output=True, text=True, timeout=100, cwd="/", env=env, check=False)
        out.append(json.loads(done.stdout.splitlines()[-1]) if done.stdout else {"failed": done.stderr})
    return out


def test_a_script_may_start_children_and_threads_which_end_with_it(readable):
    mark = Path(tempfile.mkdtemp()) / "mark"
    os.chmod(mark.parent, 0o777)
    for got in both_ways(readable, CHILDREN % str(mark)):
        assert (got.get("stdout"), got.get("exit_code"), got.get("error")) == ("1 7\n", 0, None), got
    time.sleep(4)
    assert not mark.exists()


def test_children_of_a_late_script_end_with_it(readable):
    mark = Path(tempfile.mkdtemp()) / "mark"
    os.chmod(mark.parent, 0o777)
    inner = f"import time; time.sleep(4); open({str(mark)!r}, 'w')"
    source = f"import subprocess, sys, time\nsubprocess.Popen([sys.executable, '-c', {inner!r}])\ntime.sleep(30)"
    for got in both_ways(readable, source, timeout_s=2):
        assert got["error"] == "timeout" and got["timed_out"] and got["exit_code"] is None
    time.sleep(4)
    assert not mark.exists()


def test_too_many_processes_end_a_script():
    source = "import subprocess, sys, time\nps = [subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(20)']) for _ in range(%d)]\ntime.sleep(1)\nfor p in ps: p.kill()"
    assert runner.run_script(source % 8, timeout_s=15)["error"] == "process_limit"
    assert runner.run_script(source % 3, timeout_s=15)["error"] is None


def test_limits_of_memory_files_and_output():
    assert "MemoryError" in runner.run_script("x = bytearray(3 << 30)", timeout_s=20)["stderr"]
    assert runner.run_script("open('f', 'wb').write(b'x' * 300_000_000)", timeout_s=30)["exit_code"] != 0
    assert runner.run_script("print('x' * (11 << 20))", timeout_s=20)["error"] == "invalid_output"
    assert runner.run_script("import sys\nsys.stderr.write('e' * 1_000_000)\nprint('out')\nsys.exit(3)", timeout_s=20)["exit_code"] == 3
    assert runner.run_script("import os\nos.system('ls')")["error"] == "security_violation"


def test_script_is_told_apart_by_its_mark():
    assert runner._processes(b"QUARRYMILL_RUN=none") == [] and runner._user_tasks() > 0
    with pytest.raises(PermissionError):
        runner.run_scripts(None)
