"""Model calls: once for each question, several at a time, not again after a failed task, and within the rate."""

import os
import subprocess
import sys
import textwrap
import threading
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from hopweave.plans import calls, providers
from hopweave.plans.providers import ModelSpec, StubModel, attempted, embed, generate


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Counting(StubModel):
    """Writes a line for every call into the file that its url names."""

    def _note(self, what):
        with open(self.spec.url, "a") as f:
            f.write(f"{what}\n")

    def generate(self, prompt, image=None):
        self._note(prompt)
        return super().generate(prompt, image)

    def embed(self, text):
        self._note(text)
        return super().embed(text)


def counted(path):
    return path.read_text().splitlines() if path.exists() else []


def test_every_text_is_embedded_once(spark, tmp_path):
    """A filter on the vector doesn't ask for it a second time."""
    providers.register("counting", Counting)
    path = tmp_path / "calls"
    spec = ModelSpec(provider="counting", url=str(path))
    rows = spark.createDataFrame([(i, f"text {i % 40}" if i % 9 else None) for i in range(200)], "id long, text string").repartition(1)
    made = rows.withColumn("vector", embed(F.col("text"), spec)).where("vector is not null")
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert made.count() == sum(1 for i in range(200) if i % 9)
    assert sorted(counted(path)) == sorted({f"text {i % 40}" for i in range(200) if i % 9})


def test_threads_micro_batches_and_the_log(tmp_path):
    running, most, lock = [0], [0], threading.Lock()
    asked = []

    def call(q, _):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            asked.append(q)
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return ("", "broken") if q == "bad" else (f"to {q}", None)

    spec = ModelSpec(concurrency=4)
    log = (str(tmp_path), "one")
    questions = [(f"q{i % 50}", None) for i in range(120)] + [("bad", None)]
    got = calls.Caller(spec, "generate", call, log).ask(questions)
    assert got[:120] == [(f"to q{i % 50}", None) for i in range(120)] and got[120] == ("", "broken")
    assert len(asked) == 51 and 2 <= most[0] <= 4
    again = calls.Caller(spec, "generate", call, log)
    assert again.ask(questions) == got and asked[51:] == ["bad"]  # what failed is asked again
    other = calls.Caller(ModelSpec(model="other"), "generate", call, log)
    other.ask([("q1", None)])
    assert asked[52:] == ["q1"]  # another model's reply is no reply
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".tmp")]


def test_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    rate = calls.Rate(4, lambda: now[0], sleep)
    for _ in range(9):
        rate.wait()
    assert abs(now[0] - 2.0) < 1e-9 and len(slept) == 8
    calls.Rate(None, None, None).wait()


def test_a_log_is_a_table_of_replies(spark, tmp_path):
    spec = ModelSpec()
    rows = spark.createDataFrame([(i, f"say {i % 7}") for i in range(30)], "id long, prompt string").repartition(3)
    first = generate(rows, spec, log=(str(tmp_path), "a")).collect()
    known = calls.replies(spark, str(tmp_path), "a")
    assert known.count() == 7 and calls.replies(spark, str(tmp_path), "b").count() == 0
    joined = rows.withColumn("key", calls.keyed(F.col("prompt"), spec)).join(known, "key").select("id", "reply").collect()
    assert {(r["id"], r["reply"]) for r in joined} == {(r["id"], r["reply"]) for r in first}


def test_a_task_that_fails_asks_nothing_twice(tmp_path):
    """In a session of its own, whose tasks may run again: each dies once, in the middle of its questions."""
    script = textwrap.dedent(
        f"""
        import os
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from hopweave.plans import providers
        from test_calls import Counting
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "20").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")

        class Dying(Counting):
            def generate(self, prompt, image=None):
                number = int(prompt.split()[-1])
                if number % 50 == 47 and TaskContext.get().attemptNumber() == 0:
                    os._exit(1)
                return super().generate(prompt, image)

        providers.register("dying", Dying)
        spec = providers.ModelSpec(provider="dying", url={str(tmp_path / "calls")!r}, concurrency=1)
        rows = spark.range(0, 100, 1, 2).selectExpr("id", "concat('say ', id) as prompt")
        got = providers.generate(rows, spec, log=({str(tmp_path / "log")!r}, "run")).collect()
        assert len(got) == 100 and all(r["reply"].endswith(str(r["id"])) for r in got)
        """
    )
    here = os.path.dirname(os.path.abspath(__file__))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.path.dirname(here), here, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=200, env=env)
    assert done.returncode == 0, done.stderr[-2000:]
    asked = counted(tmp_path / "calls")
    # Only the micro-batch that was under way when its task died is asked again.
    assert len(set(asked)) == 100 and len(asked) - 100 <= 2 * calls.MICRO


def test_failures_are_rows_with_an_error(spark):
    assert attempted(lambda: 1 / 0, 2, 0, lambda s: None)[1].startswith("ZeroDivisionError")
