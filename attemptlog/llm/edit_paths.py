"""Cheapest edits of role sequences, as numpy over many pieces of conversations at once.

Roles pass through four states: nothing kept yet (0), a system turn (1), a user turn (2), an
assistant turn (3); a conversation may end in 0 or 3.  Each edit leads from a state to one state.
"""

from __future__ import annotations

import numpy as np

LETTERS = np.frombuffer(b"DIKR", np.uint8)          # in ASCII order
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NONE, BLANK, DUPLICATE, CUT = range(4)              # faults
SYSTEM, USER, ASSISTANT, OTHER = range(4)           # initials s, u, a and any other
FAR = 1 << 40
#: State after a further user or assistant turn; -1 where there is none.
_STEP = {USER: [2, 2, -1, 2], ASSISTANT: [-1, -1, 3, -1], SYSTEM: [1, -1, -1, -1], OTHER: [-1] * 4}
_INSERTED = np.array([2, 2, 3, 2])                  # the only turn that may follow each state


def code_of(fault, initial):
    return fault * 4 + initial


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state by row code, state and edit (D, K, R)."""
    cost, to = np.full((16, 4, 3), FAR, np.int64), np.zeros((16, 4, 3), np.int64)
    for fault in range(4):
        for initial in range(4):
            c = code_of(fault, initial)
            for q in range(4):
                cost[c, q, 0], to[c, q, 0] = DELETE, q
                if fault in (BLANK, DUPLICATE):
                    continue
                extra = TRUNCATED if fault == CUT else 0
                if _STEP[initial][q] >= 0:
                    cost[c, q, 1], to[c, q, 1] = extra, _STEP[initial][q]
                cost[c, q, 2], to[c, q, 2] = REROLE + extra, _INSERTED[q]
    return cost, to


_COST, _TO = _tables()


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest way through two cost matrices, one after the other."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(-2)


def _closure() -> np.ndarray:
    once = np.full((4, 4), FAR, np.int64)
    once[np.arange(4), _INSERTED] = INSERT
    c = np.full((4, 4), FAR, np.int64)
    c[np.arange(4), np.arange(4)] = 0
    for _ in range(3):
        c = np.minimum(c, _least(c, once))
    return c


_INSERTS = _closure()
#: Cost to come to an end from each state behind the last row.
END = np.minimum(_INSERTS[:, 0], _INSERTS[:, 3])


def _row_matrices() -> np.ndarray:
    m = np.full((16, 4, 4), FAR, np.int64)
    for c in range(16):
        for q in range(4):
            for k in range(3):
                m[c, q, _TO[c, q, k]] = min(m[c, q, _TO[c, q, k]], _COST[c, q, k])
    return _least(np.broadcast_to(_INSERTS, m.shape), m)


_ROWS = _row_matrices()


def matrices(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each piece (``codes[ends[k-1]:ends[k]]``) the least cost from every state to every state."""
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    out = np.full((len(size), 4, 4), FAR, np.int64)
    out[:, np.arange(4), np.arange(4)] = 0
    s, n = starts[order], size[order]
    for i in range(int(n[0]) if len(n) else 0):
        live = order[:np.searchsorted(-n, -i, "left")]
        out[live] = np.minimum(_least(out[live], _ROWS[codes[s[:len(live)] + i]]), FAR)
    return out


def through(matrix: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to come to an end before a piece, from those behind it."""
    return np.minimum((matrix + after[..., None, :]).min(-1), FAR)


def least_audits(codes: np.ndarray, ends: np.ndarray, after: np.ndarray, last: np.ndarray,
                 entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the ASCII-least cheapest edits through each piece from each entry.

    ``after`` (pieces, 4): cost to come to an end behind the piece; ``last``: whether its conversation
    ends there, so that turns may still be inserted; ``entries`` (m, 2): piece and state at its start.
    Returns all letters end to end, where each entry's end in them, and the state behind each.

    Nodes are (place, state).  After the costs to go are known, edits that lose nothing
    are the optimal arcs; those of one node have different letters.  Nodes are ranked by the first
    letter of their least audit, then by 2, 4, 8 ... letters: the rank of twice the length is that
    of (rank, rank at the pointer), and pointers double as well.  Paths are read off the doubled
    pointers, every place of every path at once.
    """
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    base = starts + np.arange(len(size))            # first place of a piece; it has size + 1
    places = int(ends[-1]) + len(size) if len(size) else 0
    go = np.full((places, 4), FAR, np.int64)
    arc = np.full((places, 4, 4), FAR, np.int64)    # cost to go by letter D, I, K, R
    to = np.tile((np.arange(places)[:, None] * 4 + np.arange(4))[:, :, None], (1, 1, 4))
    final = base + size
    go[final] = after
    to[final, :, 1] = final[:, None] * 4 + _INSERTED
    arc[final, :, 1] = np.where(last[:, None], INSERT + after[:, _INSERTED], FAR)
    order = np.argsort(-size, kind="stable")
    n, state = size[order], np.arange(4)
    for back in range(1, (int(n[0]) if len(n) else 0) + 1):
        k = order[:np.searchsorted(-n, -back, "right")]
        at = base[k] + size[k] - back
        c = codes[starts[k] + size[k] - back]
        target = _TO[c]
        edits = _COST[c] + go[at + 1][np.arange(len(k))[:, None, None], target]
        here = np.minimum(edits.min(-1), FAR)
        g = np.minimum((_INSERTS + here[:, None, :]).min(-1), FAR)
        go[at] = g
        arc[at[:, None], state, 1] = INSERT + g[:, _INSERTED]
        to[at[:, None], state, 1] = at[:, None] * 4 + _INSERTED
        arc[at[:, None, None], state[:, None], [0, 2, 3]] = edits
        to[at[:, None, None], state[:, None], [0, 2, 3]] = (at[:, None, None] + 1) * 4 + target
    best = (arc == go[:, :, None]) & (go[:, :, None] < FAR)
    # behind the last row, and where a piece ends, an audit of no letters is over
    over = np.zeros((places, 4), bool)
    over[final] = ~last[:, None] | np.isin(np.arange(4), [0, 3])
    best &= ~over[:, :, None]
    best, to = best.reshape(-1, 4), to.reshape(-1, 4)
    has = best.any(1)
    first = best.argmax(1)
    nodes = np.arange(len(first))
    pointer = np.where(has, to[nodes, first], nodes)
    rank = np.where(has, first + 1, 0)
    length = has.astype(np.int64)
    pointers = [pointer]
    while True:
        pair = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        length = length + length[pointer]
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            break
        pointer = further
        pointers.append(pointer)
    start = base[entries[:, 0]] * 4 + entries[:, 1]
    many = length[start]
    upto = np.cumsum(many)
    total = int(upto[-1]) if len(upto) else 0
    step = np.arange(total) - np.repeat(upto - many, many)
    node = np.repeat(start, many)
    for k, jump in enumerate(pointers):
        odd = (step >> k) & 1 == 1
        node[odd] = jump[node[odd]]
    return LETTERS[first[node]], upto, pointers[-1][start] % 4
