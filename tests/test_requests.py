"""A bounded number of open requests, in a partition and in all of them together."""

import os
import tempfile
import threading
import time
import uuid

import pandas as pd
import pytest

from parlance.operators import models


def test_a_window_keeps_order_and_its_bound():
    lock, state = threading.Lock(), {"now": 0, "most": 0}

    def ask(x):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.002 * (x % 5))
        with lock:
            state["now"] -= 1
        return -x

    pulled = []
    items = (pulled.append(i) or i for i in range(60))
    got = []
    for item, answer in models.in_order(items, ask, 4):
        got.append((item, answer))
        assert len(pulled) - len(got) <= 4  # nothing is read ahead of the window
    assert got == [(i, -i) for i in range(60)] and 2 <= state["most"] <= 4


def counting(folder):
    """A model whose every call is a file in a folder while it lasts, and which says how many were there."""

    class Counting:
        def describe(self, prompt: pd.Series) -> pd.DataFrame:
            path = os.path.join(folder, uuid.uuid4().hex)
            open(path, "w").close()
            time.sleep(0.01)
            n = len(os.listdir(folder))
            os.remove(path)
            return pd.DataFrame({"response": [f"{n}|{len(prompt)}|{prompt.iloc[0]}"]})

    return Counting


@pytest.mark.parametrize("limit, at_once", [(1, 1), (4, 2), (6, 4)])
def test_the_cluster_never_sees_more_than_the_limit(spark, limit, at_once):
    folder = tempfile.mkdtemp()
    rows = spark.range(0, 120, 1, 8).selectExpr("id", "concat('row ', id) as prompt")
    got = models.requests(rows, "describe", counting(folder), limit=limit, at_once=at_once).collect()
    assert sorted(r.id for r in got) == list(range(120)) and all(r.response.split("|")[1:] == ["1", r.prompt] for r in got)
    assert max(int(r.response.split("|")[0]) for r in got) <= limit
    assert os.listdir(folder) == []


def test_a_failing_request_is_asked_again_and_a_bound_makes_sense(spark):
    class Shaky:
        calls = 0

        def describe(self, prompt):
            Shaky.calls += 1
            if Shaky.calls % 3 == 1:
                raise OSError
            return pd.DataFrame({"response": prompt})

    ask = models.with_retries(Shaky().describe, sleep=lambda s: None)
    got = list(models.in_order(iter([pd.Series(["a"]), pd.Series(["b"])]), ask, 1))
    assert [a.response[0] for _, a in got] == ["a", "b"]
    with pytest.raises(ValueError):
        models.requests(spark.range(1), "describe", limit=2, at_once=3)
    assert models.requests(spark.createDataFrame([], "prompt string"), "describe").collect() == []


def test_answers_are_handed_on_together(spark, monkeypatch):
    sizes, real = [], pd.concat
    prompts = [f"p{i}" for i in range(600)]

    class Rows:
        columns, dtypes = ["prompt"], [("prompt", "string")]

        def repartition(self, n):
            return self

        def mapInPandas(self, run, schema):
            out = list(run(iter([pd.DataFrame({"prompt": prompts[:500]}), pd.DataFrame({"prompt": prompts[500:]})])))
            sizes.extend(len(x) for x in out)
            return real(out)

    got = models.requests(Rows(), "describe")
    assert sizes == [256, 244, 100] and got["prompt"].tolist() == prompts
    assert all(str(len(p)) in r for p, r in zip(prompts, got["response"]))
