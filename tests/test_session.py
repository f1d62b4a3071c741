import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from plumbline.session import local_session
import __spark_entry__ as entry
spark = local_session("2", 2)
spark.sparkContext.setLogLevel("OFF")
print("rows", entry.queries()["m18_clopper_pearson"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_get_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
