"""What a file imports, by language: (local name, module as it is written). A null name binds nothing but needs the module."""

from __future__ import annotations

import re

_NAME = r"[^\W\d][\w$]*"
_STRING = r"""['"]([^'"\n]+)['"]"""


def _commas(text: str) -> list[str]:
    """Parts between commas outside of braces."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _script(code: str, commonjs: bool) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    for m in re.finditer(rf"^\s*import\s+(?:type\s+)?([^;'\"()]*?)\s*from\s*{_STRING}|^\s*import\s*{_STRING}", code, re.M):
        if m[3]:
            out.append((None, m[3]))
            continue
        found = [x.split()[-1] for part in re.findall(r"\{([^}]*)\}", m[1]) for x in part.split(",") if x.strip()]
        found += [x.split()[-1] for x in re.sub(r"\{[^}]*\}", "", m[1]).split(",") if x.strip()]
        out += [(x, m[2]) for x in found] or [(None, m[2])]
    if commonjs:
        bound = set()
        for m in re.finditer(rf"(?:\b(?:const|let|var)\s+|,\s*)(\{{[^{{}}]*\}}|{_NAME})\s*=\s*(?=require\s*\(\s*{_STRING}\s*\))", code):
            bound.add(m.end())
            names = [x.split("=")[0].split(":")[-1].strip() for x in m[1].strip("{}").split(",")]
            out += [(x, m[2]) for x in names if re.fullmatch(_NAME, x)]
        out += [(None, m[1]) for m in re.finditer(rf"(?<![\w$.])require\s*\(\s*{_STRING}\s*\)", code) if m.start() not in bound]
    return out


def _use(tree: str, prefix: str = "") -> list[tuple[str | None, str]]:
    """A Rust use tree; names in braces may hold trees again."""
    join = lambda a, b: f"{a}::{b}" if a and b else a or b
    if m := re.fullmatch(r"(?:(.*?)::)?\s*\{(.*)\}", tree, re.S):
        inner = join(prefix, (m[1] or "").strip())
        return [x for part in _commas(m[2]) for x in _use(part, inner)]
    path, _, alias = (x.strip() for x in re.sub(r"\s+as\s+", "\0", tree).partition("\0"))
    if path == "self" and prefix:
        return [(alias or prefix.rsplit("::", 1)[-1], prefix)]
    whole = join(prefix, path.removeprefix("::"))
    if path.endswith("*"):
        return [(None, whole)]
    return [(alias or path.rsplit("::", 1)[-1], whole)]


def _php(code: str) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    for m in re.finditer(r"^\s*use\s+(?:function\s+|const\s+)?([^;({]+(?:\{[^}]*\})?)\s*;", code, re.M):
        for part in _commas(m[1]):
            group = re.fullmatch(r"(.*?)\\?\{(.*)\}", part, re.S)
            head, names = (group[1].strip() + "\\", _commas(group[2])) if group else ("", [part])
            for name in names:
                path, _, alias = (x.strip() for x in re.sub(r"^(?:function|const)\s+", "", name).replace(" as ", "\0").partition("\0"))
                out.append((alias or path.rsplit("\\", 1)[-1], head + path))
    return out


def _python(code: str) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, str]] = []
    for m in re.finditer(r"^\s*(?:from\s+(\.*)([\w.]*)\s+import\s+\(?([^()\n]+)|import\s+([^\n;]+))", code, re.M):
        if m[4]:
            for part in m[4].split(","):
                name, _, alias = part.strip().partition(" as ")
                out.append((alias.strip() or name.split(".")[0], name.replace(".", "/") if alias else name.split(".")[0]))
        else:
            start = "" if not m[1] else "./" if len(m[1]) == 1 else "../" * (len(m[1]) - 1)
            module = start + m[2].replace(".", "/") if m[1] else m[2]
            out += [(x.strip().rpartition(" as ")[2], module) for x in m[3].split(",") if x.strip()]
    return out


def imports_of(language: str, code: str) -> list[dict]:
    """The imports of a source without comments."""
    out: list[tuple[str | None, str]] = []
    if language in ("typescript", "tsx", "javascript", "jsx"):
        out = _script(code, language in ("javascript", "jsx"))
    elif language == "python":
        out = _python(code)
    elif language == "rust":
        out = [x for m in re.finditer(r"^(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M) for x in _use(m[1].strip())]
    elif language == "go":
        for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|([^\n(]+))", code, re.M):
            for m in re.finditer(r'(?:([\w.]+)[ \t]+)?["`]([^"`]+)["`]', block[1] or block[2] or ""):
                out.append((m[1] or m[2].rsplit("/", 1)[-1], m[2]))
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", code, re.M):
            out.append((m[1].rsplit(".", 1)[-1], m[1]) if not m[2] else (m[1], m[1]))
    elif language == "csharp":
        out = [(m[1] or m[2].rsplit(".", 1)[-1], m[2]) for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", code, re.M)]
    elif language == "ruby":
        out = [(m[1].rsplit("/", 1)[-1], m[1]) for m in re.finditer(rf"^require(?:_relative)?\s*\(?\s*{_STRING}", code, re.M)]
    elif language == "php":
        out = _php(code)
    elif language in ("c", "cpp"):
        out = [(re.sub(r"\.[^.]*$", "", m[1]).rsplit("/", 1)[-1], m[1]) for m in re.finditer(r"""^\s*#\s*include\s*[<"]([^>"\n]+)[>"]""", code, re.M)]
    return [{"local_name": a, "module_path": b} for a, b in dict.fromkeys(out)]
