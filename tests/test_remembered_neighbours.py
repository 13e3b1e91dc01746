"""Nearest points of places that move: those that are remembered are those of a whole search."""

import numpy as np

from cairn.operators import registration
from cairn.operators.registration import NearestAsTheyMove, nearest_of_all


def _searched(monkeypatch):
    counted, search = [], NearestAsTheyMove._search
    monkeypatch.setattr(NearestAsTheyMove, "_search", lambda self, rows, a: (counted.append(len(rows)), search(self, rows, a))[1])
    return counted


def test_remembered_rows_are_those_of_a_whole_search(monkeypatch):
    rng, counted = np.random.default_rng(4), _searched(monkeypatch)
    for n, m, step in ((300, 400, 0.02), (300, 400, 3.0), (50, 7, 0.5), (40, 300, 0.0)):
        b = rng.uniform(-5, 5, (m, 3))
        a, radius = rng.uniform(-6, 6, (n, 3)), 2.0
        nearest = NearestAsTheyMove(b, radius)
        for _ in range(6):
            at, d2 = nearest(a)
            want, least = nearest_of_all(a, b)
            near = least <= radius**2
            assert np.array_equal(d2 <= radius**2, near) and np.array_equal(at[near], want[near]) and np.array_equal(d2[near], least[near])
            a = a + rng.normal(0, step, (1, 3))
    assert sum(counted) < 6 * (300 + 300 + 50 + 40)


def test_ties_go_to_the_smaller_row_however_many_there_are():
    b = np.repeat(np.array([[1.0, 0, 0], [-1.0, 0, 0], [0, 4.0, 0]]), 30, axis=0)[::-1]
    a = np.array([[0.0, 0, 0], [0.0, 3.0, 0], [0.5, 0, 0]])
    nearest = NearestAsTheyMove(b, 10.0)
    for _ in range(3):
        assert np.array_equal(nearest(a)[0], nearest_of_all(a, b)[0])
        a = a + np.array([-0.25, 0, 0])


def test_a_registration_searches_most_places_once(monkeypatch):
    rng, counted = np.random.default_rng(5), _searched(monkeypatch)
    cloud, normals = rng.uniform(-4, 4, (600, 3)), rng.normal(0, 1, (600, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    start = np.eye(4)
    start[:3, 3] = 0.15, -0.1, 0.05
    p = registration.IcpParams(min_translation=1e-9, min_rotation=1e-9)
    t, overlap = registration.icp(cloud, normals, cloud, normals, np.ones(600), start, p)
    assert np.allclose(t, np.eye(4), atol=1e-6) and overlap > 0.7 and 600 <= sum(counted) < 1500
