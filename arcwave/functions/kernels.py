"""Small sequential helpers for one connected part of a graph at a time; callers bound its edges.

Ids are any ascending integers; adjacency is visited in ascending order, and no helper recurses.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np


class Local:
    """Compressed rows of one part, over 0..n in the order of its global ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate([src, dst]))
        s, t = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((t, s))
        self.n = len(self.ids)
        self.row = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=self.n))]).tolist()
        self.to = t[order].tolist()
        self.indegree = np.bincount(t, minlength=self.n).tolist()


def components(g: Local) -> tuple[list[int], int, int]:
    """For each vertex the least vertex that it and the other reach mutually; the largest stack of open vertices, and of frames."""
    low, seen = [0] * g.n, [0] * g.n
    closed, least = [False] * g.n, [0] * g.n
    open_: list[int] = []
    clock = most_open = most_frames = 0
    for root in range(g.n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        frames = [[root, g.row[root]]]
        while frames:
            most_open, most_frames = max(most_open, len(open_)), max(most_frames, len(frames))
            v, at = frames[-1]
            if at < g.row[v + 1]:
                frames[-1][1] += 1
                w = g.to[at]
                if not seen[w]:
                    clock += 1
                    seen[w] = low[w] = clock
                    open_.append(w)
                    frames.append([w, g.row[w]])
                elif not closed[w]:
                    low[v] = min(low[v], seen[w])
                continue
            frames.pop()
            if frames:
                low[frames[-1][0]] = min(low[frames[-1][0]], low[v])
            if low[v] == seen[v]:
                group = [open_.pop()]
                while group[-1] != v:
                    group.append(open_.pop())
                first = min(group)
                for w in group:
                    closed[w], least[w] = True, first
    return least, most_open, most_frames


def ranks(g: Local) -> tuple[list[int], list[int], list[int]]:
    """Longest-path rank, the predecessor whose turn released each vertex (-1: none), and the vertices in the order of their turns in a first-in-first-out queue."""
    left, rank, by = list(g.indegree), [0] * g.n, [-1] * g.n
    queue = deque(v for v in range(g.n) if not left[v])
    turns = []
    while queue:
        v = queue.popleft()
        turns.append(v)
        for w in g.to[g.row[v] : g.row[v + 1]]:
            left[w] -= 1
            rank[w] = max(rank[w], rank[v] + 1)
            if not left[w]:
                by[w] = v
                queue.append(w)
    return rank, by, turns


def breadth_first(g: Local, start: int) -> list[int]:
    seen, order = {start}, [start]
    for v in order:
        for w in g.to[g.row[v] : g.row[v + 1]]:
            if w not in seen:
                seen.add(w)
                order.append(w)
    return order


def depth_first(g: Local, start: int, seen: set[int]) -> list[int]:
    """Last-in-first-out order that marks a vertex when it is pushed; larger successors are pushed first."""
    seen.add(start)
    stack, order = [start], []
    while stack:
        v = stack.pop()
        order.append(v)
        for w in reversed(g.to[g.row[v] : g.row[v + 1]]):
            if w not in seen:
                seen.add(w)
                stack.append(w)
    return order


def depth_first_rows(row: np.ndarray, to: np.ndarray, seen: bytearray, roots: Iterator[int]) -> Iterator[tuple[int, int]]:
    """(root, vertex) turn by turn of the same order from each root not yet seen, over compressed rows that may be a mapped file."""
    stack = array("I")
    for root in roots:
        if seen[root]:
            continue
        seen[root] = 1
        stack.append(root)
        while stack:
            v = stack.pop()
            yield root, v
            for w in reversed(to[row[v] : row[v + 1]].tolist()):
                if not seen[w]:
                    seen[w] = 1
                    stack.append(w)


def chains(v: np.ndarray, last: np.ndarray, ended: np.ndarray, least: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    """Pointers v -> last followed to their end, with the smallest of ``least`` and the sum of ``d`` on the way; on a cycle none ends."""
    order = np.argsort(v)
    v, last, ended, least, d = (x[order].copy() for x in (v, last, ended, least, d))
    at, reach = np.searchsorted(v, last), 1
    while reach < 2 * len(v) and not ended.all():
        go = np.flatnonzero(~ended)
        to = at[go]
        last[go], least[go], d[go], new, ends = last[to], np.minimum(least[go], least[to]), d[go] + d[to], at[to], ended[to]
        at[go], ended[go] = new, ends
        reach *= 2
    return {"v": v, "last": last, "ended": ended, "least": least, "d": d}
