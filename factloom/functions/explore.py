"""Abstract execution of a control-flow graph: which nodes are reached with which constants, and how runs end.

A state is a node and the names whose value is a known constant. A constant is kept only where it fits the receiver's
picture; everything else that is written becomes unknown, and an unknown effect forgets all. A condition over known
constants decides its branch; any other goes both ways. States are bounded: what is left out is reported as `cut`, never
taken for unreachable.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from decimal import Decimal

from factloom.functions import cobol
from factloom.functions.flow import Graph, Node

_MOVE = re.compile(r"^MOVE\s+('[^']*'|\"[^\"]*\"|[+-]?\d+(?:\.\d+)?|ZEROE?S?|SPACES?)\s+TO\s+([\w-]+)$", re.I)
_TEST = re.compile(r"^(?P<left>[\w-]+)\s*(?P<op><>|<=|>=|=|<|>)\s*(?P<right>'[^']*'|\"[^\"]*\"|[+-]?\d+(?:\.\d+)?|ZEROE?S?|SPACES?)$", re.I)


@dataclass
class Exploration:
    """reached: nodes; ends: (node, constants there, witness of nodes) of each run that leaves the graph; decided: conditions
    that only ever went one way; cut: whether a limit left states out."""

    reached: set[int] = field(default_factory=set)
    ends: list[tuple[int, dict[str, str], tuple[int, ...]]] = field(default_factory=list)
    decided: dict[int, set[str]] = field(default_factory=dict)
    cut: bool = False


def _constant(word: str) -> str:
    if word[0] in "'\"":
        return word[1:-1]
    up = word.upper()
    return "0" if up.startswith("ZERO") else "" if up.startswith("SPACE") else format(Decimal(word).normalize(), "f")


def fits(value: str, pic: str | None) -> bool:
    """Does a receiver of this picture hold the constant without a change?"""
    if pic is None:
        return False
    number = cobol.picture(pic)
    if number is not None:
        try:
            status, kept = cobol.store(Decimal(value), number)
        except ArithmeticError:
            return False
        return status == "stored" and kept == Decimal(value)
    size = len(re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic))
    return set(pic.upper()) <= set("XA()0123456789") and len(value) <= size


def _holds(text: str, known: dict[str, str]) -> bool | None:
    m = _TEST.match(text.strip())
    left = known.get(m["left"].upper()) if m else None
    if left is None:
        return None
    right = _constant(m["right"])
    try:
        a, b = Decimal(left), Decimal(right)
    except ArithmeticError:
        a, b = left.rstrip(), right.rstrip()  # type: ignore[assignment]
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[m["op"]]


def _after(n: Node, known: dict[str, str], pictures: dict[str, str]) -> dict[str, str]:
    if n.unknown:
        return {}
    out = {x: v for x, v in known.items() if x not in n.writes}
    m = _MOVE.match(n.text.strip())
    if m and n.writes == [m[2].upper()] and fits(_constant(m[1]), pictures.get(m[2].upper())):
        out[m[2].upper()] = _constant(m[1])
    return out


def explore(g: Graph, pictures: dict[str, str], initial: dict[str, str] | None = None, max_states: int = 20_000) -> Exploration:
    """All states from the first node on. pictures: of the names that may hold constants; initial: known values."""
    out = Exploration()
    if not g.nodes:
        return out
    after: dict[int, list[tuple[int, str]]] = {n.number: [] for n in g.nodes}
    for a, b, label in g.edges:
        after[a].append((b, label))
    todo = deque([(0, tuple(sorted((initial or {}).items())), (0,))])
    seen = {todo[0][:2]}
    while todo:
        k, state, way = todo.popleft()
        n, known = g.nodes[k], dict(state)
        out.reached.add(k)
        condition = " ".join(n.text.split(" ")[1 : _length(n)]) if n.verb == "IF" else ""
        truth = _holds(condition, known) if condition else None
        steps = [(b, label) for b, label in after[k] if truth is None or label not in ("branch:0", "branch:1") or label == ("branch:0" if truth else "branch:1")]
        if truth is not None:
            out.decided.setdefault(k, set()).add("true" if truth else "false")
        elif n.verb == "IF":
            out.decided.setdefault(k, set()).update(("true", "false"))
        now = tuple(sorted(_after(n, known, pictures).items()))
        if not after[k] or (truth is not None and not steps):
            out.ends.append((k, dict(now), way))
        for b, _ in steps:
            if (b, now) in seen:
                continue
            if len(seen) >= max_states:
                out.cut = True
                continue
            seen.add((b, now))
            todo.append((b, now, (*way, b)[-200:]))
    return out


def _length(n: Node) -> int:
    """How many words of an IF are its condition: up to its first nested statement."""
    words = n.text.split(" ")
    return next((i for i, w in enumerate(words) if i and (w.upper() in cobol.VERBS or w.upper() in ("THEN", "ELSE", "END-IF"))), len(words))
