"""Source texts as tokens: words, numbers, strings and marks with their places, and the mates of brackets.

A text is read once from left to right. Comments and preprocessor lines are left out; what is
inserted into strings (``${..}`` in JavaScript, ``#{..}`` in Ruby) is read as code.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_MARK = r"\.\.\.|=>|->|\?->|\?\.(?!\d)|\?\?|::|&&=?|\|\|=?|===?|!==?|<=|>=|[-+*/%^&|]=|\+\+|--|."
_WORD = r"[^\W\d]\w*"

# What each family skips, its strings and its words, in the order that they are tried.
_RULES = {
    "js": (_COMMENT + r"|^\#![^\n]*", f"{_QUOTED}|{_SINGLE}", r"[#$]?[^\W\d][\w$]*|\$[\w$]*"),
    "rust": (_COMMENT, r'b?r(?P<hashes>#*)"(?:.|\n)*?"(?P=hashes)|b?"(?:\\(?:.|\n)|[^"\\])*"|b?\'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^\\\'\n])\'|\'[^\W\d]\w*', r"(?:r\#)?" + _WORD),
    "go": (_COMMENT, rf"{_QUOTED}|`[^`]*`|{_SINGLE}", _WORD),
    "java": (_COMMENT, rf'"""(?:\\.|[^\\])*?"""|{_QUOTED}|{_SINGLE}', r"[^\W\d][\w$]*"),
    "csharp": (_COMMENT + r"|\#[^\n]*", rf'\$?@\$?"(?:[^"]|"")*"|"""(?:.|\n)*?"""|\$?{_QUOTED}|{_SINGLE}', "@?" + _WORD),
    "php": (_COMMENT + r"|\#(?!\[)[^\n]*", r"<<<[ \t]*(?:'(?P<now>\w+)'|\"?(?P<here>\w+)\"?)\n(?:.|\n)*?\n[ \t]*(?:(?P=now)|(?P=here))\b|" + r'"(?:\\(?:.|\n)|[^"\\])*"|\'(?:\\(?:.|\n)|[^\'\\])*\'', r"\$?\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*"),
    "c": (_COMMENT + r"|\#(?:\\\r?\n|[^\n])*", rf'(?:u8|[uUL])?R"(?P<d>[^(\s]*)\((?:.|\n)*?\)(?P=d)"|(?:u8|[uUL])?{_QUOTED}|(?:[uUL])?{_SINGLE}', _WORD),
    "ruby": (r"\#[^\n]*|^=begin\b(?:.|\n)*?^=end[^\n]*", rf"'(?:\\.|[^'\\])*'|%[wWiI](?:\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}})|%[qQ]?(?:\([^)]*\)|\{{[^}}]*\}})|:{_WORD}[?!]?(?!:)|:{_QUOTED}|\?\w\b", rf"(?:@@?|\$)?{_WORD}(?:[?!](?![=~]))?"),
}
_MASTERS = {
    family: re.compile(rf"(?P<blank>[^\S\n]+)|(?P<line>\n)|(?P<skip>{skip})|(?P<s>{strings})|(?P<n>\d(?:[eE][-+]\d|[\w.])*)|(?P<w>{words})|(?P<p>{_MARK})", re.M)
    for family, (skip, strings, words) in _RULES.items()
}
_TEMPLATE = {"`": (re.compile(r"(?:[^`\\$]|\\(?:.|\n)|\$(?!\{))*"), "${"), '"': (re.compile(r'(?:[^"\\#]|\\(?:.|\n)|#(?!\{))*'), "#{")}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_HEREDOC = re.compile(r"<<[~-]?(['\"`]?)([A-Z_]\w*)\1")
#: A slash after one of these words or after a mark that ends no operand begins a regular expression.
_BEFORE_REGEX = set("return typeof case in of do else when if unless and or not while until puts then".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """Parallel lists: ``text``, ``kind`` (w, n, s, p), ``at``, ``end``, ``line`` (from 1), ``fresh`` (first of its line) and ``mate``.

    ``mate`` is the other bracket of a pair; an opening one without a mate has the number of tokens, others have -1. One
    empty token at the end spares tests of bounds.
    """

    def __init__(self, source: str, family: str):
        self.source, self.family = source, family
        self.text: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.comments: list[tuple[int, int]] = []
        self._read()
        breaks = [m.start() for m in re.finditer("\n", source)]
        self.breaks = breaks
        self.line = [bisect_right(breaks, a - 1) + 1 for a in self.at]
        self.fresh = [not i or self.line[i] > self.line[i - 1] for i in range(len(self.at))]
        self.mate = self._mates()
        for known, value in ((self.text, ""), (self.kind, ""), (self.at, len(source)), (self.end, len(source)), (self.line, len(breaks) + 1), (self.fresh, True), (self.mate, -1)):
            known.append(value)

    def __len__(self) -> int:
        return len(self.text) - 1

    def column(self, i: int) -> int:
        return self.at[i] - (self.breaks[self.line[i] - 2] + 1 if self.line[i] > 1 else 0)

    def slice(self, first: int, last: int) -> str:
        """The source from token ``first`` to token ``last``, both included."""
        return self.source[self.at[first] : self.end[last]]

    def code(self) -> str:
        """The source with comments as blanks, of the same length and lines."""
        parts, done = [], 0
        for a, b in self.comments:
            parts += [self.source[done:a], re.sub(r"[^\n]", " ", self.source[a:b])]
            done = b
        return "".join([*parts, self.source[done:]])

    def _add(self, kind: str, a: int, b: int) -> None:
        self.text.append(self.source[a:b])
        self.kind.append(kind)
        self.at.append(a)
        self.end.append(b)

    def _regex_may_begin(self, at: int) -> bool:
        if not self.text:
            return True
        last, kind = self.text[-1], self.kind[-1]
        if kind == "p":
            return last not in (")", "]", "}")
        spaced = self.end[-1] < at and self.source[at + 1 : at + 2] not in (" ", "=", "")
        return kind == "w" and (last in _BEFORE_REGEX or self.family == "ruby" and spaced)

    def _read(self) -> None:
        source, n, master = self.source, len(self.source), _MASTERS[self.family]
        quote = {"js": "`", "ruby": '"'}.get(self.family, "")
        jumps: dict[int, int] = {}  # from the end of a line to that of the here-document after it
        open_at: list[int] = []  # depth of braces at which a template goes on
        depth, pos = 0, 0
        if self.family == "php":
            start = re.search(r"<\?(?:php\b|=)?", source)
            pos = start.end() if start else n

        def template(a: int) -> int:
            body, mark = _TEMPLATE[quote]
            b = body.match(source, a + 1).end()
            if source.startswith(mark, b):
                self._add("s", a, b)
                open_at.append(depth)
                return b + 2
            self._add("s", a, min(b + 1, n))
            return b + 1

        while pos < n:
            c = source[pos]
            if c == quote:
                pos = template(pos)
                continue
            if c == "}" and open_at and depth == open_at[-1]:
                open_at.pop()
                pos = template(pos)
                continue
            if c == "/" and self.family in ("js", "ruby") and not source.startswith(("//", "/*"), pos) and self._regex_may_begin(pos) and (m := _REGEX.match(source, pos)):
                self._add("s", pos, m.end())
                pos = m.end()
                continue
            if c == "<" and self.family == "ruby" and (m := _HEREDOC.match(source, pos)):
                stop = source.find("\n", pos)
                last = re.compile(rf"^[ \t]*{m[2]}[ \t]*$", re.M).search(source, jumps.get(stop, stop) + 1) if stop >= 0 else None
                if last:
                    self._add("s", pos, m.end())
                    jumps[stop] = last.end()
                    pos = m.end()
                    continue
            m = master.match(source, pos)
            kind, end = m.lastgroup, m.end()
            if kind == "line":
                end = jumps.get(pos, end)
            elif kind == "skip" and (c != "#" or self.family not in ("c", "csharp")):
                self.comments.append((pos, end))
            elif kind in ("s", "n", "w", "p"):
                if kind == "p":
                    if c == "{":
                        depth += 1
                    elif c == "}":
                        depth -= 1
                    elif c == "?" and self.family == "php" and source.startswith("?>", pos):
                        again = source.find("<?", end)
                        pos = n if again < 0 else re.compile(r"<\?(?:php\b|=)?").match(source, again).end()
                        self._add("p", end, end)
                        self.text[-1] = ";"
                        continue
                self._add(kind, pos, end)
            pos = max(end, pos + 1)

    def _mates(self) -> list[int]:
        mate, open_ = [-1] * len(self.text), []
        for i, t in enumerate(self.text):
            if self.kind[i] != "p":
                continue
            if t in ("(", "[", "{"):
                open_.append(i)
                mate[i] = len(self.text)
            elif t in _PAIRS:
                # A brace closes what was left open within it; other brackets do not reach over braces.
                k = len(open_) - 1
                while k >= 0 and self.text[open_[k]] != _PAIRS[t] and (t == "}" or self.text[open_[k]] != "{"):
                    k -= 1
                if k >= 0 and self.text[open_[k]] == _PAIRS[t]:
                    mate[open_[k]], mate[i] = i, open_[k]
                    del open_[k:]
        return mate
