"""Models behind a child process: order, nulls, restarts, time limits, and answers that do not belong."""

import sys

import pytest
from pyspark.sql import functions as F

from plumeline.operators.models import apply_model, checked
from plumeline.operators.subprocess_model import subprocess_model

CHILD = """
import json, os, sys, time
mark = sys.argv[2]
held = []
for n, line in enumerate(sys.stdin):
    q = json.loads(line)
    a = {"id": q["id"], "result": q["text"].upper()}
    if sys.argv[1] in ("dies", "hangs") and n == 3 and not os.path.exists(mark):
        open(mark, "w").close()
        if sys.argv[1] == "dies":
            os._exit(1)
        time.sleep(60)
    if sys.argv[1] == "silent":
        continue
    if sys.argv[1] == "twice":
        print(json.dumps(a), flush=True)
    held.append(a)
    if len(held) == 2 or sys.argv[1] != "swapped":  # answers in another order
        for x in reversed(held):
            print(json.dumps(x), flush=True)
        held = []
"""


def asked(spark, tmp_path, how, n=40, **more):
    script = tmp_path / "child.py"
    script.write_text(CHILD)
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 != 7, F.concat(F.lit("text é "), F.col("id"))).alias("t")).repartition(1 if how == "swapped" else 2)
    load = subprocess_model([sys.executable, str(script), how, str(tmp_path / "mark")], **more)
    return rows, apply_model(rows, "t", load, "answer", "string")


@pytest.mark.parametrize(("how", "more"), [("plain", {}), ("swapped", {"batch": 2}), ("dies", {"batch": 5}), ("hangs", {"batch": 5, "seconds": 3})])
def test_every_text_gets_its_answer(spark, tmp_path, how, more):
    rows, got = asked(spark, tmp_path, how, **more) if how != "swapped" else asked(spark, tmp_path, how, n=20, **more)
    got = got.cache()
    assert {r.id: r.answer for r in got.collect()} == {r.id: r.t and r.t.upper() for r in rows.collect()}
    assert checked(rows, got, "id").count() == 0


def test_silence_and_repeated_answers_fail(spark, tmp_path):
    with pytest.raises(Exception, match="no answer within"):
        asked(spark, tmp_path, "silent", seconds=1, restarts=1)[1].collect()
    with pytest.raises(Exception, match="came twice"):
        asked(spark, tmp_path, "twice", batch=3)[1].collect()
