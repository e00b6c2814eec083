"""Minimum-cost edit scripts between nested schemas.

A schema is a tree: a node has a kind and named children (the keys of an object). Children have no order. A script is a
list of edits - added, removed, renamed, retyped, moved - and its cost is the sum of theirs. A field whose name is in both
objects is the same field. All other nodes, of every level, are paired at once: the pairing of least total cost decides which
are renamed within their object, which are moved to another one, and which come and go. The cost of a pair counts all that
differs below it.

Two fields may be one quantity if their names share words and their values don't speak against it, or if their values agree so
well that the name doesn't matter, and if they aren't known to stand side by side elsewhere. Names weigh by the lengths of their words and by how many fields share them; values by
their kind, their distribution (numbers) and what they have in common; objects by their members. There are no lists of words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

# --- fixed values ------------------------------------------------------------------------------------------------
ADD_COST = REMOVE_COST = 1.0
RETYPE_COST = 0.5
MOVE_COST = 0.5
#: Likeness (of names and values together) from which two fields may be one quantity.
ALIKE = 0.55
#: What values add to the likeness or take from it at most; what two yes/no fields add, which have little to tell.
VALUES, BITS = 0.6, 0.4
#: A word of so many letters has its full weight; an abbreviation shares this much of it, and more the longer it is.
FULL_WORD, ABBREVIATED = 4, 0.5
#: Numbers from which distributions are compared, and from which they alone can tell that two fields are one.
FEW, MANY = 3, 100
#: Distributions that overlap more than this don't speak against it, by chance they may differ so much.
TOGETHER = 0.9
#: The least variance (of the inverse hyperbolic sine) that counts, and how many numbers of common variance are mixed in.
LEAST_VARIANCE, SHARED = 0.02, 3
#: Bits of the map of values (each value sets one); a map more than half full tells nothing.
MAP_BITS = 256
# ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Values:
    """Sums over the single values of a field: how many are numbers, sum and sum of squares of asinh of those, how many are
    whole and how many negative, and the map of numbers and texts."""

    numbers: int = 0
    total: float = 0.0
    squares: float = 0.0
    whole: int = 0
    negative: int = 0
    seen: int = 0


@dataclass
class Node:
    """kind: number, text, boolean, list, object or None (unknown); leaf: kind of the single values inside (bit: 0 or 1)."""

    kind: str | None = None
    leaf: str | None = None
    children: dict[str, Node] = field(default_factory=dict)
    values: Values = Values()

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


@dataclass(frozen=True)
class Edit:
    change: str
    path: str
    old_path: str
    old_kind: str | None = None
    new_kind: str | None = None
    cost: float = 0.0


def tree(rows: Iterable[tuple]) -> Node:
    """The schema of (path, kind, leaf[, values]) rows; a path is a list of keys joined by U+001F."""
    root = Node("object")
    for path, kind, leaf, *values in sorted(rows, key=lambda r: (r[0].count("\x1f"), r[0])):
        *above, name = path.split("\x1f")
        at = root
        for key in above:
            at = at.children.setdefault(key, Node("object"))
        node = at.children.setdefault(name, Node())
        node.kind, node.leaf = kind, leaf
        if values and values[0]:
            node.values = values[0]
    return root


def words(name: str) -> list[str]:
    """The words of a field name, in lower case: breaks are signs, digits and changes of case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+", name)]


def _shared(a: str, b: str) -> float:
    """1 for equal words, less if one is an abbreviation (the first letters) of the other, else 0."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    return ABBREVIATED + (1 - ABBREVIATED) * len(short) / len(long) if len(short) >= 3 and long.startswith(short) else 0.0


class Names:
    """Likeness of names within two schemas: a word that many fields share weighs less."""

    def __init__(self, old: Iterable[str], new: Iterable[str]):
        self.schemas = [[words(n) for n in old], [words(n) for n in new]]
        self.weights: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if word not in self.weights:
            many = max(1, *(sum(any(_shared(word, w) for w in name) for name in schema) for schema in self.schemas))
            self.weights[word] = min(1.0, len(word) / FULL_WORD) / many
        return self.weights[word]

    def likeness(self, a: str, b: str) -> float:
        """From 0 to 1: shared weight over the weight of the lighter name."""
        x, y = words(a), words(b)
        left, shared = list(y), 0.0
        for w in x:
            twin = max(left, key=lambda v: _shared(w, v), default=None)
            if twin is not None and _shared(w, twin):
                left.remove(twin)
                shared += _shared(w, twin) * min(self.weight(w), self.weight(twin))
        least = min(sum(map(self.weight, x)), sum(map(self.weight, y)))
        return min(1.0, shared / least) if least else 0.0


def _overlap(x: Values, y: Values) -> float:
    """Overlap (Bhattacharyya) of the distributions of two fields' numbers, taken as normal after asinh; less by what one has
    of negative numbers and the other has not."""
    means = [s.total / s.numbers for s in (x, y)]
    spread = [max(0.0, s.squares / s.numbers - m * m) + LEAST_VARIANCE for s, m in zip((x, y), means, strict=True)]
    common = (x.numbers * spread[0] + y.numbers * spread[1]) / (x.numbers + y.numbers)
    v, w = ((s.numbers * u + SHARED * common) / (s.numbers + SHARED) for s, u in zip((x, y), spread, strict=True))
    signs = abs(x.negative / x.numbers - y.negative / y.numbers)
    return (1 - signs) * math.sqrt(2 * math.sqrt(v * w) / (v + w)) * math.exp(-((means[0] - means[1]) ** 2) / (4 * (v + w)))


def _in_common(x: Values, y: Values) -> float:
    """Part of the values of the field of fewer different ones that the other has too, from 0 to 1; 0 if that can't be told."""
    p, q, both = x.seen.bit_count(), y.seen.bit_count(), (x.seen & y.seen).bit_count()
    by_chance = p * q / MAP_BITS
    return max(0.0, (both - by_chance) / (min(p, q) - by_chance)) if 2 <= min(p, q) and max(p, q) <= MAP_BITS / 2 else 0.0


def evidence(x: Node, y: Node) -> float | None:
    """What the values add to the likeness of two fields (less than 0 if they speak against it); None if their kinds differ."""
    leaves = {x.leaf, y.leaf} - {None}
    if len(leaves) == 2 and "bit" not in leaves or leaves == {"bit", "text"}:
        return None
    if leaves and leaves <= {"boolean", "bit"}:
        return BITS if x.leaf and y.leaf else 0.0
    a, b = x.values, y.values
    said = VALUES * _in_common(a, b)
    if leaves == {"number"} and min(a.numbers, b.numbers) >= FEW:
        overlap = _overlap(a, b)
        if overlap < TOGETHER:
            return said - VALUES * (1 - overlap)
        if min(a.numbers, b.numbers) >= MANY and abs(a.whole / a.numbers - b.whole / b.numbers) < 0.1:
            said = max(said, VALUES * (overlap - TOGETHER) / (1 - TOGETHER))
    return said


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a pairing of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    row_price, col_price = [0.0] * (n + 1), [0.0] * (m + 1)
    owner = [0] * (m + 1)
    for r in range(1, n + 1):
        owner[0] = r
        slack, came, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        col = 0
        while True:
            used[col] = True
            at, step, nxt = owner[col], float("inf"), 0
            for c in range(1, m + 1):
                if used[c]:
                    continue
                reduced = cost[at - 1][c - 1] - row_price[at] - col_price[c]
                if reduced < slack[c]:
                    slack[c], came[c] = reduced, col
                if slack[c] < step:
                    step, nxt = slack[c], c
            for c in range(m + 1):
                if used[c]:
                    row_price[owner[c]] += step
                    col_price[c] -= step
                else:
                    slack[c] -= step
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col], col = owner[came[col]], came[col]
    out = [-1] * n
    for c in range(1, m + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


@dataclass(frozen=True)
class _Place:
    """A node that has no twin: its object (the path of the pair of objects it is in, None inside a node without twin)."""

    path: str
    node: Node
    object: str | None
    above: tuple[int, ...]

    @property
    def name(self) -> str:
        return self.path.rpartition("\x1f")[2]


def _join(above: str, name: str) -> str:
    return f"{above}\x1f{name}" if above else name


def _inside(places: list[_Place], path: str, node: Node, level: str | None, above: tuple[int, ...] = ()) -> None:
    """The node and all below it."""
    own = len(places)
    places.append(_Place(path, node, level, above))
    for name, child in sorted(node.children.items()):
        _inside(places, _join(path, name), child, None, (*above, own))


def _retyped(x: Node, y: Node) -> bool:
    return bool(x.kind and y.kind and x.kind != y.kind)


def _groups(pairs: Iterable[tuple[int, int]], gone: list[_Place], come: list[_Place]) -> list[list[tuple[int, int]]]:
    """Pairs that have to do with one another: they share a node, or one has a node above the other's."""
    owner: dict[tuple[str, int], tuple[str, int]] = {}

    def find(x):
        while owner.setdefault(x, x) != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    pairs = list(pairs)
    for g, c in pairs:
        owner[find(("old", g))] = find(("new", c))
    for side, places in (("old", gone), ("new", come)):
        for i, p in enumerate(places):
            if (side, i) in owner:
                for above in p.above:
                    if (side, above) in owner:
                        owner[find((side, i))] = find((side, above))
    groups = defaultdict(list)
    for g, c in pairs:
        groups[find(("old", g))].append((g, c))
    return list(groups.values())


def _best(gains: dict[tuple[int, int], float], gone: list[_Place], come: list[_Place]) -> tuple[float, list[tuple[int, int]]]:
    """The pairs of greatest total gain: a node in one pair at most, and none in a pair that has a node above it in another."""
    if not gains:
        return 0.0, []
    rows, cols = sorted({g for g, _ in gains}), sorted({c for _, c in gains})
    table = [[-gains.get((g, c), 0.0) for c in cols] + [0.0] * len(rows) for g in rows]
    picked = [(g, cols[j]) for g, j in zip(rows, assign(table), strict=True) if j < len(cols) and (g, cols[j]) in gains]
    for k, places in ((0, gone), (1, come)):
        used = {p[k] for p in picked}
        for at in used:
            over = next((a for a in places[at].above if a in used), None)
            if over is not None:  # either the one or the other
                tries = (_best({p: v for p, v in gains.items() if p[k] != out}, gone, come) for out in (at, over))
                return max(tries, key=lambda t: t[0])
    return sum(gains[p] for p in picked), picked


def _compare(old: Node, new: Node, old_at: str, new_at: str, known: dict, apart: frozenset) -> tuple[float, list[Edit]]:
    """(cost, edits) between the children of two nodes that are one field; paths start with ``old_at`` and ``new_at``."""
    if (old_at, new_at) in known:
        return known[old_at, new_at]
    out: list[Edit] = []
    gone: list[_Place] = []
    come: list[_Place] = []
    names: dict[str, Names] = {}
    level = [(old, new, old_at, new_at)]
    while level:
        x, y, at, to = level.pop()
        for name in sorted(set(x.children) - set(y.children)):
            _inside(gone, _join(at, name), x.children[name], to)
        for name in sorted(set(y.children) - set(x.children)):
            _inside(come, _join(to, name), y.children[name], to)
        names[to] = Names(x.children, y.children)
        for name in sorted(set(x.children) & set(y.children)):
            a, b = x.children[name], y.children[name]
            if _retyped(a, b):
                out.append(Edit("retyped", _join(to, name), _join(at, name), a.kind, b.kind, RETYPE_COST))
            elif a.children or b.children:
                level.append((a, b, _join(at, name), _join(to, name)))
    gains: dict[tuple[int, int], float] = {}
    costs: dict[tuple[int, int], float] = {}
    for i, g in enumerate(gone):
        for j, c in enumerate(come):
            if g.object is None and c.object is None:  # it comes along with what it is in
                continue
            renamed = g.object == c.object
            if (g.name, c.name) in apart if renamed else g.name != c.name:
                continue
            said = evidence(g.node, c.node)
            if said is None:
                continue
            apiece = REMOVE_COST * (g.node.size() - 1) + ADD_COST * (c.node.size() - 1)
            below = apiece
            if g.node.children and c.node.children and not _retyped(g.node, c.node):
                below = _compare(g.node, c.node, g.path, c.path, known, apart)[0]
                said += VALUES * (1 - below / apiece)
            alike = said + (names[g.object].likeness(g.name, c.name) if renamed else 1.0)
            if alike < ALIKE:
                continue
            cost = 0.2 + 1.2 * (1 - min(1.0, alike)) if renamed else MOVE_COST
            if _retyped(g.node, c.node):
                cost += RETYPE_COST / 2
            gain = REMOVE_COST * g.node.size() + ADD_COST * c.node.size() - cost - below
            if gain > 0:
                gains[i, j], costs[i, j] = gain, cost
    pairs = [p for group in _groups(gains, gone, come) for p in _best({p: gains[p] for p in group}, gone, come)[1]]
    for i, j in pairs:
        g, c = gone[i], come[j]
        change = "renamed" if g.object == c.object else "moved"
        out.append(Edit(change, c.path, g.path, g.node.kind, c.node.kind, costs[i, j]))
        if _retyped(g.node, c.node):
            out.append(Edit("retyped", c.path, g.path, g.node.kind, c.node.kind, RETYPE_COST))
        elif g.node.children and c.node.children:
            out += _compare(g.node, c.node, g.path, c.path, known, apart)[1]
    for k, change, places in ((0, "removed", gone), (1, "added", come)):
        used = {p[k] for p in pairs}
        for i, p in enumerate(places):
            if p.object is not None and i not in used:
                left = p.node.size() - sum(places[u].node.size() for u in used if i in places[u].above)
                kinds = (p.node.kind, None) if change == "removed" else (None, p.node.kind)
                out.append(Edit(change, p.path, p.path if change == "removed" else "", *kinds, REMOVE_COST * left))
    known[old_at, new_at] = (sum(e.cost for e in out), out)
    return known[old_at, new_at]


def script(old: Node, new: Node, apart: frozenset[tuple[str, str]] = frozenset()) -> list[Edit]:
    """The edits of least total cost that turn ``old`` into ``new``. ``apart``: pairs of names known to be different fields."""
    return _compare(old, new, "", "", {}, apart)[1]
