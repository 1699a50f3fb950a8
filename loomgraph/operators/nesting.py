"""A nesting graph that one process holds and that takes one edge at a time: every node has a place, a container before what it holds. For graphs of any size, whole batches go through operators.rules.add_edges.

An edge between nodes in order, or with a new one, costs a few dictionary operations; an edge against the order costs a search between the two places only, after which the nodes found share their places anew. An edge that would close a
cycle is refused, and nothing has changed then.
"""

from __future__ import annotations

from collections.abc import Iterable

from loomgraph.operators.graph import CycleError


class Nesting:
    __slots__ = ("above", "below", "first", "last", "place")

    def __init__(self, edges: Iterable[tuple[str, str]] = ()):
        self.below: dict[str, set[str]] = {}
        self.above: dict[str, set[str]] = {}
        self.place: dict[str, int] = {}
        self.first, self.last = 0, -1  # the first and the last place taken
        for parent, child in edges:
            self.add(parent, child)

    def copy(self) -> Nesting:
        """A graph of its own that is as this one is now."""
        new = Nesting()
        new.below, new.above = ({k: set(v) for k, v in side.items()} for side in (self.below, self.above))
        new.place, new.first, new.last = dict(self.place), self.first, self.last
        return new

    def add(self, parent: str, child: str) -> None:
        """Adds an edge, once; CycleError if it closes a cycle."""
        place = self.place
        if parent == child:
            raise CycleError(f"{parent!r} can't hold itself")
        p, c = place.get(parent), place.get(child)
        if p is not None and c is not None:
            if child in self.below[parent]:
                return
            if p > c:
                self._reorder(parent, child, p, c)
        else:
            if p is None and c is not None:
                self.first -= 1
                self._new(parent, self.first)
            elif p is None:
                self.last += 1
                self._new(parent, self.last)
            if c is None:
                self.last += 1
                self._new(child, self.last)
        self.below[parent].add(child)
        self.above[child].add(parent)

    def _new(self, node: str, place: int) -> None:
        self.place[node], self.below[node], self.above[node] = place, set(), set()

    def _reorder(self, parent: str, child: str, high: int, low: int) -> None:
        """Puts what leads to the parent before what the child leads to, in the places that both have between the two."""
        place = self.place
        after = _between(child, self.below, place, low, high)
        if parent in after:
            raise CycleError(f"{child!r} holds {parent!r} already")
        before = _between(parent, self.above, place, low, high)
        at = place.__getitem__
        moved = sorted(before, key=at) + sorted(after, key=at)
        place.update(zip(moved, sorted(map(at, moved)), strict=True))

    def reachable(self, node: str) -> set[str]:
        """What a node holds, at any depth, and itself."""
        return _between(node, self.below, self.place, self.first, self.last)

    def would_cycle(self, parent: str, child: str) -> bool:
        return parent == child or parent in self.reachable(child)

    def containers(self) -> dict[str, set[str]]:
        """By node: what holds it."""
        return {n: set(v) for n, v in self.above.items()}


def _between(start: str, links: dict[str, set[str]], place: dict[str, int], low: int, high: int) -> set[str]:
    """The start and what its links lead to by way of nodes placed from low to high."""
    seen, stack = {start}, [start]
    while stack:
        for n in links.get(stack.pop(), ()):
            if n not in seen and low <= place[n] <= high:
                seen.add(n)
                stack.append(n)
    return seen
