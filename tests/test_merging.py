"""Incremental merging gives the log of a search that votes and compares everything at every step."""

import numpy as np
import pytest

from parlance.operators import speakers


def by_hand(part, centroid, kept, symmetry):
    clusters, log = [[i] for i in range(len(part))], []
    both = {"min": min, "max": max, "mean": lambda a, b: (a + b) / 2}[symmetry]
    while True:
        n, parts = len(clusters), [{part[i] for i in c} for c in clusters]
        centres = [m / max(np.linalg.norm(m), 1e-12) for m in (centroid[c].mean(0) for c in clusters)]
        share = np.zeros((n, n))
        for i, c in enumerate(clusters):
            ballots, open_to = [v for m in c for v in kept[m]], [j for j in range(n) if j != i and not parts[i] & parts[j]]
            for v in ballots if open_to else []:
                share[i, open_to[int(np.argmax([(v * centres[j]).sum() for j in open_to]))]] += 1
            share[i] /= max(len(ballots), 1)
        pairs = [(both(share[a, b], share[b, a]), a, b) for a in range(n) for b in range(a + 1, n) if not parts[a] & parts[b]]
        if not pairs:
            return log
        best, a, b = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        rivals = [both(share[x, k], share[k, x]) for x in (a, b) for k in range(n) if k not in (a, b)]
        log.append((min(clusters[a]), min(clusters[b]), best, best - max(rivals) if rivals else 1.0, sorted(clusters[a] + clusters[b])))
        clusters[a] += clusters.pop(b)


@pytest.mark.parametrize("symmetry", ["min", "max", "mean"])
def test_logs_are_equal(symmetry):
    rng = np.random.default_rng(3)
    for trial in range(80):
        n = int(rng.integers(0, 16))
        part, centroid = rng.integers(0, 5, n).tolist(), rng.normal(size=(n, 6))
        centroid /= np.linalg.norm(centroid, axis=1, keepdims=True)
        kept = [rng.normal(size=(int(rng.integers(0, 6)), 6)) + 3 * centroid[i] for i in range(n)]
        if trial % 4 == 0:  # ties
            centroid, kept = np.round(centroid) + 0.0, [np.round(k) for k in kept]
        got, want = speakers.agglomerate(part, centroid, kept, symmetry), by_hand(part, centroid, kept, symmetry)
        assert [(m["a"], m["b"], m["members"]) for m in got] == [(w[0], w[1], w[4]) for w in want]
        assert np.allclose([[m["affinity"], m["margin"]] for m in got], [w[2:4] for w in want]) if want else True


def test_only_those_concerned_vote_again():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    part, voice = [i % 8 for i in range(40)], [i // 8 for i in range(40)]
    centroid = np.array([centres[v] for v in voice]) + 0.1 * rng.normal(size=(40, 16))
    centroid /= np.linalg.norm(centroid, axis=1, keepdims=True)
    ballots = speakers.Ballots(part, centroid, [centroid[i] + 0.1 * rng.normal(size=(20, 16)) for i in range(40)])
    first = ballots.recounted
    assert first == 800
    ballots.merge(0, 1)
    assert ballots.recounted - first < 0.6 * 800


def test_margins_without_a_rival():
    two = speakers.agglomerate([0, 1], np.eye(2), [np.eye(2)[:1], np.eye(2)[1:]])
    assert [(m["affinity"], m["margin"]) for m in two] == [(1.0, 1.0)]
    # the third shares a part with both, so it can't merge, but is there: 0 is the alternative
    three = speakers.agglomerate([0, 1, 0], np.eye(3), [np.eye(3)[i : i + 1] for i in range(3)])
    assert three[0]["alternative"] >= 0 and three[-1]["margin"] <= 1.0
