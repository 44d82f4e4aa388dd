"""Python by its own parser, walked breadth first."""

from __future__ import annotations

import ast
from collections import deque

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.match_case)


def _complexity(node: ast.AST) -> int:
    total = 1
    for x in ast.walk(node):
        total += isinstance(x, BRANCHES)
        if isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
    return total


def _callee(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *parts[::-1]])
    return None


def _module(name: str | None, level: int) -> str:
    if not level:
        return name or ""
    start = "./" if level == 1 else "../" * (level - 1)
    return start + (name or "").replace(".", "/")


def extract(path: str, text: str) -> dict:
    tree = ast.parse(text)
    symbols, calls, imports = [], [], []
    todo: deque[tuple[ast.AST, str | None, str | None, bool]] = deque((x, None, None, False) for x in tree.body)
    while todo:
        node, parent, caller, in_class = todo.popleft()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            is_class = isinstance(node, ast.ClassDef)
            qualified = f"{parent or path}.{node.name}"
            kind = "class" if is_class else "method" if in_class else "function"
            signature = None if is_class else f"({ast.unparse(node.args)})"
            returns = ast.unparse(node.returns) if not is_class and node.returns else None
            symbols.append({
                "kind": kind, "name": node.name, "qualified_name": qualified, "line_start": node.lineno, "line_end": node.end_lineno or node.lineno, "signature": signature,
                "return_type": returns, "receiver_type": parent if kind == "method" else None, "is_exported": False, "complexity": 0 if is_class else _complexity(node),
                "decorators": [ast.unparse(d) for d in node.decorator_list],
            })
            todo.extend((x, qualified, None if is_class else qualified, is_class) for x in node.body)
            continue
        if isinstance(node, ast.Import):
            imports += [{"local_name": a.asname or a.name.split(".")[0], "module_path": a.name.replace(".", "/") if a.asname else a.name.split(".")[0]} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [{"local_name": a.asname or a.name, "module_path": _module(node.module, node.level)} for a in node.names]
        elif isinstance(node, ast.Call) and (name := _callee(node.func)):
            calls.append({"callee": name, "line": node.lineno, "col": node.col_offset, "caller_qualified": caller})
        if not in_class or not isinstance(node, ast.stmt):
            todo.extend((x, parent, caller, False) for x in ast.iter_child_nodes(node))
    return {"symbols": symbols, "calls": calls, "imports": imports}
