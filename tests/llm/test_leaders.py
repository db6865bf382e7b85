"""Leading within tasks and over all, against leading everything at once."""

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import ngram_join


@pytest.mark.parametrize("seed", range(8))
def test_leaders_in_tasks_lead_to_the_same_leaders(seed):
    """Parts led within tasks first, then over all: the pairs are those of leading all entries at once."""
    rng = np.random.default_rng(seed)
    part, doc = rng.integers(0, 60, 900).astype(np.uint64), rng.integers(0, 200, 900)
    task = doc % 7 if seed % 2 else rng.integers(0, 7, 900)  # a repeated row may be in several tasks
    tables = {"near": [], "far": []}
    heads = []
    for t in range(7):
        column, leader, *local = ngram_join._lead(part[task == t], doc[task == t])
        heads.append((column, leader))
        tables["near"].append(local)
    tables["far"].append(ngram_join._lead(*(np.concatenate(x) for x in zip(*heads)))[2:])
    made = {}
    for name, of, mid in (("near", 0, 1), ("far", 1, 0)):
        packed = [ngram_join._packed(x[3], x[2]).to_pylist() for x in tables[name]]
        made[name] = pa.table({("member", "leader")[of]: np.concatenate([x[of] for x in tables[name]]), "mid": np.concatenate([x[mid] for x in tables[name]]), "parts": pa.array(sum(packed, []), pa.binary())})
    found = ngram_join.follow(made["near"], made["far"])
    got = set(zip(found["member"].to_pylist(), found["leader"].to_pylist()))
    got |= set(zip(made["far"]["mid"].to_pylist(), made["far"]["leader"].to_pylist()))
    least = {}
    for p, d in zip(part.tolist(), doc.tolist()):
        least[p] = min(d, least.get(p, d))
    assert got == {(d, least[p]) for p, d in zip(part.tolist(), doc.tolist()) if d != least[p]}
    none = ngram_join.follow(made["near"].slice(0, 0), made["far"])
    assert none.num_rows == 0 and ngram_join.follow(made["near"], made["far"].slice(0, 0)).num_rows > 0
