"""Documents that hold a flow: the text of their ```flow blocks, in order."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^```flow[^\n]*\n(.*?)^```\s*$", re.MULTILINE | re.DOTALL)


def flow_of(document: str) -> str:
    return "\n".join(m[1] for m in _FENCE.finditer(document))


def mermaid(program) -> str:
    """The plan as a Mermaid graph, a node for each scope."""
    lines = ["graph TD"]
    for i, scope in enumerate(program.scopes):
        label = scope.label or f"_{i}"
        ops = " / ".join([scope.head.op, *[s.op for s in scope.steps if s.op != "branch"]])
        lines.append(f'  {label}["{label}: {ops}"]')
        a = scope.head.args
        for name in [a[k] for k in ("name", "left", "right") if isinstance(a.get(k), str) and scope.head.op in ("ref", "materialize", "join", "asof")] + list(a.get("names", [])):
            lines.append(f"  {name} --> {label}")
        for s in scope.steps:
            if s.op == "branch":
                lines.append(f"  {label} --> {s.args['label']}")
    return "\n".join(lines) + "\n"
