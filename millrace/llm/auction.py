"""Cheapest repair of a run of messages: an auction over the lattice of positions and states.

A lattice node is (messages consumed, state), the state being what the repaired messages end with.
Arcs are edits. The auction keeps a path from the entry and a price per node, and raises the price
of the path's last node to the cheapest way on: the path loses a node whose price rose and grows
along an arc whose cost the prices pay exactly. When it reaches the sink the prices are dual
optimal, so an arc lies on some cheapest path only if it is tight, and the first path in the order
of the edits' letters is found among tight arcs that lead to the sink.

Prices rise by small whole steps, so long runs are cut into blocks and blocks are joined by their
costs between states.
"""

from __future__ import annotations

from functools import lru_cache

#: What the repaired messages end with: nothing yet, a leading system message, a user, an assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a message that has to come next; a system message only opens.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What edits cost, and what a truncated message that stays costs beside.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Messages of a block.
BLOCK = 16
#: Costs from each state at the end of a conversation; None where it may not end.
END = (0, None, None, 0)

Costs = tuple[int | None, ...]


def kept(message: str, state: int) -> int | None:
    """The state after keeping a message, if it may stand there. Messages are s, u, a or o, upper case if truncated."""
    if message in "sS":
        return SYSTEM if state == EMPTY else None
    if message in "uU":
        return USER if NEXT[state] == USER else None
    if message in "aA":
        return ASSISTANT if NEXT[state] == ASSISTANT else None
    return None


def lattice(block: str, sinks: Costs) -> tuple[list[list[tuple[str, int, int]]], int]:
    """The arcs (letter, target, cost) of each node, and the sink. Node 4 * i + q has i messages behind it."""
    sink = 4 * (len(block) + 1)
    arcs = []
    for i in range(len(block) + 1):
        for q in STATES:
            out = []
            if i < len(block):
                extra = TRUNCATED if block[i].isupper() else 0
                out.append(("D", 4 * (i + 1) + q, DELETE))
                to = kept(block[i], q)
                if to is not None:
                    out.append(("K", 4 * (i + 1) + to, extra))
                out.append(("R", 4 * (i + 1) + NEXT[q], REROLE + extra))
            elif sinks[q] is not None:
                out.append(("", sink, sinks[q]))
            out.append(("I", 4 * i + NEXT[q], INSERT))
            arcs.append(out)
    return arcs, sink


def auction(arcs: list[list[tuple[str, int, int]]], source: int, sink: int) -> list[int]:
    """Node prices under which a path of tight arcs leads from source to sink, which must be in reach."""
    price = [0] * (sink + 1)
    path = [source]
    while path[-1] != sink:
        end = path[-1]
        least, to = min((cost + price[target], target) for _, target, cost in arcs[end])
        if price[end] < least:
            price[end] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price


def traced(arcs: list[list[tuple[str, int, int]]], price: list[int], source: int, sink: int) -> tuple[str, int]:
    """The first letters of a path of tight arcs, and the state it ends in."""
    good = [False] * sink + [True]

    def leading(node: int) -> list[tuple[str, int]]:
        return [(letter, to) for letter, to, cost in arcs[node] if good[to] and price[node] == cost + price[to]]

    for first in range(sink - 4, -1, -4):
        for _ in range(2):  # an insertion leads to a node of the same position, and from there to another one
            for node in range(first, first + 4):
                good[node] = good[node] or bool(leading(node))
    letters, node = [], source
    while True:
        letter, to = min(leading(node))
        if to == sink:
            return "".join(letters), node % 4
        letters.append(letter)
        node = to


@lru_cache(maxsize=1 << 16)
def repaired(block: str, entry: int, sinks: Costs) -> tuple[int, str, int]:
    """(cost, letters, end state) of the cheapest edits of a block, with the costs from its end on."""
    arcs, sink = lattice(block, sinks)
    price = auction(arcs, entry, sink)
    return price[entry] - price[sink], *traced(arcs, price, entry, sink)


def reaches(block: str, entry: int, end: int) -> bool:
    if end == EMPTY:
        return entry == EMPTY
    if end == SYSTEM:
        return entry == SYSTEM or entry == EMPTY and "s" in block.lower()
    return True


@lru_cache(maxsize=1 << 16)
def between(block: str) -> tuple[Costs, ...]:
    """Costs of a block from each entry state to each end state."""
    only = lambda end: tuple(0 if q == end else None for q in STATES)
    return tuple(
        tuple(repaired(block, entry, only(end))[0] if reaches(block, entry, end) else None for end in STATES) for entry in STATES)


def least(values) -> int | None:
    return min((v for v in values if v is not None), default=None)


def added(a: int | None, b: int | None) -> int | None:
    return None if a is None or b is None else a + b


def joined(first: tuple[Costs, ...], then: tuple[Costs, ...]) -> tuple[Costs, ...]:
    """Costs through two runs of messages."""
    return tuple(tuple(least(added(row[m], then[m][end]) for m in STATES) for end in STATES) for row in first)


def before(costs: tuple[Costs, ...], after: Costs) -> Costs:
    """Costs from the states before a run, given those after it."""
    return tuple(least(added(row[q], after[q]) for q in STATES) for row in costs)


def blocks(messages: str) -> list[str]:
    return [messages[i : i + BLOCK] for i in range(0, len(messages), BLOCK)] or [""]


def crossing(messages: str) -> tuple[Costs, ...]:
    """Costs of a run of messages from each state to each state."""
    parts = blocks(messages)
    made = between(parts[0])
    for part in parts[1:]:
        made = joined(made, between(part))
    return made


def edits(messages: str, entry: int, after: Costs) -> tuple[str, int]:
    """The letters of the cheapest edits of a run, first in order among equals, and the state they end in."""
    parts = blocks(messages)
    ahead = [after]
    for part in reversed(parts[1:]):
        ahead.append(before(between(part), ahead[-1]))
    letters = []
    for part, costs in zip(parts, reversed(ahead), strict=True):
        base = least(costs)  # equal blocks with equal differences are solved once
        _, made, entry = repaired(part, entry, tuple(None if c is None else c - base for c in costs))
        letters.append(made)
    return "".join(letters), entry
