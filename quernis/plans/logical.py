"""The readable plan: a tree of what the caller asked for, kept beside the Spark plan."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    kind: str
    detail: str
    inputs: tuple[Node, ...] = field(default=())

    def then(self, kind: str, detail: str, *more: Node) -> Node:
        return Node(kind, detail, (self, *more))

    def lines(self, depth: int = 0):
        yield f"{'  ' * depth}{self.kind}({self.detail})"
        for n in self.inputs:
            yield from n.lines(depth + 1)


def explain(root: Node | None) -> str:
    return "<empty plan>" if root is None else "".join(f"{line}\n" for line in root.lines())
