"""Model calls: one for each distinct question, over equal ones, both uses of a figure, later runs and tasks that die."""

import os
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle

from leafmill.operators import ledger, model
from leafmill.schemas import PAPER

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Counted:
    """Leaves a line for each call and answers another way each time; what `fail` names goes wrong."""

    def __init__(self, log, fail=None):
        self.log, self.fail = log, fail

    def complete(self, prompts, images):
        with open(self.log, "a") as f:
            f.write(f"{prompts[0]!r} {images[0]}\n")
        if self.fail:
            self.fail(prompts[0])
        return [f"{'seen' if images[0] else 'read'} {time.time_ns()}"]


def calls(log):
    return Counter(open(log).read().splitlines()) if os.path.exists(log) else Counter()


def questions(spark, *prompts, image=None):
    return spark.createDataFrame([(k, p, image) for k, p in enumerate(prompts)], "id int, prompt string, image string")


def answers(table):
    return {r.id: (r["__r"].reply, r["__r"].error) if r["__r"] else (None, None) for r in table.collect()}


def test_equal_questions_and_later_runs(spark, tmp_path):
    log, held = str(tmp_path / "log"), ledger.Ledger(str(tmp_path / "ledger"), "m", 3)
    got = answers(held.answered(questions(spark, "a", "b", "a", None, "b", "c"), lambda: Counted(log)))
    assert got[0] == got[2] != got[1] == got[4] and got[3] == (None, None) and got[5][0]
    assert calls(log) == Counter({"'a' None": 1, "'b' None": 1, "'c' None": 1})
    again = answers(held.answered(questions(spark, "c", "a", "d"), lambda: Counted(log)))
    assert (again[0], again[1]) == (got[5], got[0]) and calls(log)["'d' None"] == 1 and sum(calls(log).values()) == 4
    answers(held.answered(questions(spark, "a", image="cGlj"), lambda: Counted(log)))
    answers(ledger.Ledger(str(tmp_path / "ledger"), "other", 3).answered(questions(spark, "a"), lambda: Counted(log)))
    assert calls(log)["'a' cGlj"] == 1 and calls(log)["'a' None"] == 2
    table = held.answered(questions(spark, "z"), lambda: Counted(log))
    assert table.collect() == table.collect() and calls(log)["'z' None"] == 1


def test_a_job_that_dies_repeats_no_answered_question(spark, tmp_path):
    log, mark = str(tmp_path / "log"), str(tmp_path / "died")

    def die(prompt):
        if prompt == "q7" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)

    held = ledger.Ledger(str(tmp_path / "ledger"), "m", 2, ledger.Patience(at_once=1))
    asked = questions(spark, *[f"q{k}" for k in range(20)])
    with pytest.raises(Exception, match="."):
        held.answered(asked, lambda: Counted(log, die)).collect()
    before = calls(log)
    assert before["'q7' None"] == 1
    # A line that the dying task left unfinished is no answer.
    with open(held._journals(0) + "/torn.jsonl", "w") as f:
        f.write('["abc", "x')
    got = answers(held.answered(asked, lambda: Counted(log, die)))
    assert all(r and not e for r, e in got.values())
    assert {k: n for k, n in calls(log).items() if n > 1} == {"'q7' None": 2}
    assert not [f for _, _, own in os.walk(tmp_path / "ledger" / "journals") for f in own]


class RateLimitError(Exception):
    pass


def test_passing_failures_are_tried_again_and_others_are_data(spark, tmp_path):
    log = str(tmp_path / "log")

    def sometimes(prompt):
        n = sum(calls(log)[x] for x in calls(log) if x.startswith(repr(prompt)))
        if (prompt == "busy" and n < 3) or prompt == "always busy":
            raise RateLimitError("slow down")
        if prompt == "bad":
            raise ValueError("no")

    held = ledger.Ledger(str(tmp_path / "ledger"), "m", 2, ledger.Patience(at_once=4, tries=3, pause=0.01))
    got = answers(held.answered(questions(spark, "busy", "bad", "always busy", "fine"), lambda: Counted(log, sometimes)))
    assert got[0][0] and got[3][0]
    assert got[1] == (None, "ValueError: no") and got[2] == (None, "RateLimitError: slow down")
    assert {k.split("'")[1]: n for k, n in calls(log).items()} == {"busy": 3, "bad": 1, "always busy": 3, "fine": 1}
    again = answers(held.answered(questions(spark, "bad", "fine"), lambda: Counted(log)))
    assert again[0][0] and again[1] == got[3]
    assert not ledger.passes(ValueError()) and ledger.passes(TimeoutError()) and ledger.passes(type("E", (Exception,), {"status_code": 503})())


class Slow:
    def complete(self, prompts, images):
        time.sleep(0.2)
        return ["x"]


def test_calls_are_made_together(spark, tmp_path):
    held = ledger.Ledger(str(tmp_path / "ledger"), "m", 1, ledger.Patience(at_once=8))
    began = time.time()
    held.answered(questions(spark, *map(str, range(40))), Slow).collect()
    assert time.time() - began < 40 * 0.2


@pytest.mark.parametrize("with_ledger", [False, True])
def test_a_figure_is_asked_about_once(spark, tmp_path, with_ledger):
    """The description that the summary is made from is the one that is printed."""
    log = str(tmp_path / "log")
    fig = (0, (0.0, 0.0, 1.0, 1.0), "Figure 1", "it", "/c.png", None)
    papers = spark.createDataFrame([("a.pdf", "/a.pdf", "T", "some text", [fig], None)], PAPER)
    crops = spark.createDataFrame([("/c.png", bytearray(b"PNG"))], "path string, content binary")

    def keep(table, name):
        table.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(table.schema).parquet(f"{tmp_path}/{name}")

    held = ledger.Ledger(str(tmp_path / "ledger"), "m", 2) if with_ledger else None
    done = model.summarized(papers, crops, lambda: Counted(log), None, None, keep, held)
    done.write.parquet(f"{tmp_path}/done")
    row = spark.read.parquet(f"{tmp_path}/done").first()
    asked = calls(log)
    assert len(asked) == sum(asked.values()) == 3 and sum("UE5H" in k for k in asked) == 1
    seen = row.figures[0].description
    assert row.status == "ok" and any(seen in k for k in asked if k.endswith("None"))
