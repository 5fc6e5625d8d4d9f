"""The sequential helpers against closures, over all small graphs and random ones. No Spark."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arcwave.control import ExecutionControl, decomposition_charges, outcome, schedule_charges
from arcwave.errors import Cancelled, WorkLimitExceeded
from arcwave.functions import blake3, kernels


def closure(n, edges):
    reach = [[i == j for j in range(n)] for i in range(n)]
    for a, b in edges:
        reach[a][b] = True
    for k, i, j in itertools.product(range(n), repeat=3):
        reach[i][j] = reach[i][j] or reach[i][k] and reach[k][j]
    return reach


def local(edges):
    return kernels.Local(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))


def check_components(n, edges):
    if not edges:
        return
    g = local(edges)
    reach = closure(n, edges)
    least, most_open, most_frames = kernels.components(g)
    for k, v in enumerate(g.ids.tolist()):
        assert g.ids[least[k]] == min(w for w in g.ids.tolist() if reach[v][w] and reach[w][v])
    assert 1 <= most_frames <= most_open <= g.n or most_frames <= g.n


def test_all_graphs_of_three_vertices():
    pairs = list(itertools.product(range(3), repeat=2))
    for bits in range(1 << 9):
        check_components(3, [p for k, p in enumerate(pairs) if bits >> k & 1])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 8), st.data())
def test_random_graphs(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), unique=True))
    check_components(n, edges)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 8), st.data())
def test_queue_order_is_by_rank_then_releasing_predecessor(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] < p[1]), unique=True, min_size=1))
    g = local(edges)
    rank, by, turns = kernels.ranks(g)
    place = {v: k for k, v in enumerate(turns)}
    assert len(turns) == g.n
    assert turns == sorted(range(g.n), key=lambda v: (rank[v], place[by[v]] if by[v] >= 0 else -1, v))


def test_deep_chain_needs_no_recursion():
    n = 100_000
    g = kernels.Local(np.arange(n - 1), np.arange(1, n))
    assert kernels.components(g)[0] == list(range(n))
    assert kernels.ranks(g)[0][-1] == n - 1
    assert kernels.depth_first(g, 0, set())[-1] == n - 1


def test_depth_first_marks_on_push():
    g = local([(0, 1), (0, 2), (1, 2), (1, 3)])
    assert kernels.depth_first(g, 0, set()) == [0, 1, 3, 2]


def test_ledger_totals_and_stops():
    chain = decomposition_charges(4, 3, 4, 3, 3)
    total = sum(n for n, _ in chain)
    assert total == 26_756
    assert outcome(chain, total) == (True, total)
    assert outcome(chain, total - 1)[0] is False
    assert outcome(chain, 0) == (False, 0)
    assert outcome(chain, 13) == (False, 13)  # a batch of 12, then unit steps
    assert sum(n for n, _ in schedule_charges(4, 3, 4)) == 40
    assert sum(n for n, _ in decomposition_charges(0, 0, 0, 0, 0)) == 3
    assert sum(n for n, _ in schedule_charges(0, 0, 0)) == 1


def test_cancellation_comes_first():
    import threading

    event = threading.Event()
    control = ExecutionControl.with_work_limit(0).with_cancellation(event)
    try:
        control.admit([(1, False)])
    except WorkLimitExceeded as e:
        assert e == WorkLimitExceeded(0, 0)
    event.set()
    try:
        control.admit([(0, False)])
    except Cancelled as e:
        assert e == Cancelled(0)
    else:
        raise AssertionError


def test_blake3_vectors():
    data = bytes(k % 251 for k in range(102_400))
    # public test vectors: the first 32 bytes for inputs of these lengths
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(data[:1]).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3.digest(data[:1024]).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3.digest(data[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert blake3.digest(data[:2048]).hex() == "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"
    assert blake3.digest(data).hex() == "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"
