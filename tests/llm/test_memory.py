import os
import re

import pytest

from tests.llm.helpers import table
from textmill.llm import common, pii


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def fragmented(mb=160):
    """Frees that much but for a block above all the rest, so that the allocator keeps it."""
    held = [bytes(4000) for _ in range(mb * 250)]
    return held[-1]


@pytest.mark.skipif(not os.path.exists("/proc/self/statm") or common._TRIM is None, reason="not glibc")
def test_a_task_gives_its_memory_back():
    kept = []

    def run(batches):
        for b in batches:
            kept.append(fragmented())
            yield b

    whole = common.tidy(run)
    common.release()
    before = resident()
    assert list(whole(iter("ab"))) == ["a", "b"]
    assert resident() - before < 40e6
    assert whole.__name__ == "run"


def test_a_task_that_fails_gives_its_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))

    def run(batches):
        yield from batches
        raise ValueError("no")

    with pytest.raises(ValueError):
        list(common.tidy(run)(iter("a")))
    assert calls == [1]


def depths(plan):
    return [(len(m[1]), m[2]) for m in (re.match(r"([\s:+*()\d-]*)(\w+)", line) for line in plan.splitlines()) if m]


def test_no_task_of_sanitise_has_two_workers(spark):
    docs = table(spark, [(1, "write to john@doe.org now", "en", "a"), (2, "nothing here", "en", "a")])
    out = pii.sanitise(docs, report=False)
    above, met = [], 0
    for depth, node in depths(out._jdf.queryExecution().executedPlan().toString()):
        above = [(d, n) for d, n in above if d < depth]
        if node == "ArrowEvalPython":
            met += 1
            under = [n for _, n in above]
            last = max((k for k, n in enumerate(under) if n == "ArrowEvalPython"), default=None)
            assert last is None or any("Exchange" in n for n in under[last:]), "two functions in one task"
        above.append((depth, node))
    assert met == 3
    assert sorted(r["text"] for r in out.collect()) == ["nothing here", "write to [EMAIL] now"]
