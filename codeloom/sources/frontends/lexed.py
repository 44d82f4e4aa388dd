"""The languages without a parser at hand, by their tokens: declarations are told by keywords and shape, bodies by brackets.

A file is a queue of regions. Each is read once: a declaration found in it becomes a symbol, its body a
region of its own whose calls belong to it, and reading goes on behind it. So the time is linear in the file.
Files with errors still give what can be read.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import accumulate

from codeloom.sources.frontends.imports import imports_of
from codeloom.sources.frontends.tokens import Tokens

FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "jsx": "js", "rust": "rust", "go": "go", "java": "java", "csharp": "csharp", "php": "php", "c": "c", "cpp": "c", "ruby": "ruby", "python": "python"}

# Fixed values, by family: words that make a branch; words before a parenthesis that call nothing; words that may stand before a call.
BRANCHES = {
    "js": {"if", "for", "while", "do", "case"}, "rust": {"if", "for", "while"}, "go": {"if", "for"}, "java": {"if", "for", "while", "do"}, "csharp": {"if", "for", "while", "do"},
    "php": {"if", "elseif", "for", "while", "do"}, "c": {"if", "for", "while", "do"}, "ruby": {"if", "elsif", "unless", "while", "until", "for", "when"},
}
NOT_CALLED = {
    "js": set("if for while switch catch with return typeof function super import new await async of in do else case throw void delete yield constructor".split()),
    "rust": set("if for while match return in loop else fn as move mut ref let where impl dyn Fn FnMut FnOnce pub unsafe crate".split()),
    "go": set("if for switch return func go defer select range case else chan map struct interface import type var const".split()),
    "java": set("if for while switch catch return synchronized super this new try else do throw assert case instanceof".split()),
    "csharp": set("if for foreach while switch catch return lock using base this new fixed checked unchecked typeof sizeof default nameof when else do throw in is await".split()),
    "php": set("if elseif for foreach while switch catch return function fn new array list exit die print echo unset declare match use and or xor".split()),
    "c": set("if for while switch catch return sizeof alignof decltype typeof static_assert noexcept throw int char float double bool void long short unsigned signed auto defined else do new delete alignas operator".split()),
    "ruby": set("if elsif unless while until case when return super yield and or not do then in def class module end begin rescue ensure else for self nil true false alias undef defined?".split()),
}
#: Before the name of a call these words are no type, so it is no declaration.
BEFORE_CALL = set("return else do throw case in is as await yield out ref and or not when assert instanceof co_return co_await co_yield goto delete new".split())
SEPARATORS = {"js": (".", "?."), "rust": (".", "::"), "go": (".",), "java": (".",), "csharp": (".",), "php": (), "c": (".", "->", "::"), "ruby": ()}
#: After one of these a keyword begins an expression, not a statement.
IN_EXPRESSION = set("= ( , : ? [ && || ?? ! => + - * / ... return new typeof void await yield in of case throw extends . ?. <".split())
MODIFIERS = {
    "js": set("public private protected static async get set readonly override abstract declare accessor".split()),
    "rust": set("pub const async unsafe extern default".split()),
    "jvm": set("public private protected internal static final abstract virtual override async sealed synchronized native default strictfp partial extern unsafe readonly new required".split()),
    "php": set("public private protected static final abstract readonly".split()),
}


class Outline:
    """Symbols and calls of one file; ``symbols`` and ``calls`` are the rows."""

    def __init__(self, path: str, language: str, source: str):
        self.path, self.language, self.family = path, language, FAMILY[language]
        self.tokens = t = Tokens(source, self.family)
        self.text, self.kind, self.mate, self.n = t.text, t.kind, t.mate, len(t)
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.jump: dict[int, int] = {}
        self.ends = self._block_ends() if self.family == "ruby" else {}
        score = [self._branch(i) for i in range(self.n)]
        if self.family == "rust":
            for i in range(self.n):
                if self._macro(i):
                    score[i : self.mate[i + 2]] = [0] * len(score[i : self.mate[i + 2]])
        self.branches = [0, *accumulate(score)]
        declare = getattr(self, f"_{'jvm' if self.family in ('java', 'csharp') else self.family}")
        # (first token, token after the last, symbol that calls in it belong to)
        self.work: deque[tuple[int, int, str | None]] = deque([(0, self.n, None)])
        while self.work:
            i, end, parent = self.work.popleft()
            while i < end:
                after = self.jump.pop(i, None) or declare(i, end, parent)
                if after is None:
                    self._call(i, parent)
                    after = i + 1
                i = max(after, i + 1)

    # --- rows ----------------------------------------------------------------------------------------------

    def _symbol(self, kind: str, name: str, owner: str | None, first: int, last: int, *, signature: str | None = None, returns: str | None = None, receiver: str | None = None, exported: bool = False, decorators: tuple[str, ...] = (), complexity: int | None = None) -> str:
        """Add a symbol from token ``first`` to ``last``; the qualified name is returned."""
        t, last = self.tokens, min(last, self.n - 1)
        qualified = f"{owner or self.path}.{name}"
        if complexity is None:
            complexity = 1 + self.branches[last + 1] - self.branches[first] if kind in ("function", "method", "variable") else 0
        self.symbols.append({
            "kind": kind, "name": name, "qualified_name": qualified, "line_start": t.line[first], "line_end": t.line[last] + t.text[last].count("\n"), "signature": signature,
            "return_type": returns, "receiver_type": receiver, "is_exported": exported, "complexity": complexity, "decorators": list(decorators),
        })
        return qualified

    def _called(self, first: int, name: str, parent: str | None) -> None:
        self.calls.append({"callee": name, "line": self.tokens.line[first], "col": self.tokens.column(first), "caller_qualified": parent})

    def _branch(self, i: int) -> int:
        text, f = self.text, self.family
        t = text[i]
        if self.kind[i] == "w":
            if t not in BRANCHES[f] or text[i - 1] in (".", "::", "->"):
                return 0
            if t == "for" and f in ("java", "csharp", "php") and text[i + 1] == "(":
                return int(";" in text[i + 2 : self.mate[i + 1]])
            if t == "for" and f == "rust" and text[i + 1] == "<":
                return 0
            if t == "if" and f == "rust" and (self.kind[i - 1] in ("w", "n", "s") and text[i - 1] not in ("else", "return", "break", "in", "move") or text[i - 1] in (")", "]")):
                return 0  # the guard of a match arm
            # The end of a do loop is not one more.
            return 0 if t == "while" and f != "ruby" and text[i - 1] == "}" and self.mate[i - 1] > 0 and text[self.mate[i - 1] - 1] == "do" else 1
        if t == "&&" or t == "||":
            closure = f == "rust" and t == "||" and (self.kind[i - 1] == "p" and text[i - 1] not in (")", "]", "}") or text[i - 1] in ("move", "return"))
            return 0 if closure or f == "rust" and t == "&&" and self.kind[i - 1] == "p" and text[i - 1] not in (")", "]", "}") else 1
        if f == "rust":
            return int(t == "=>")
        if t == "?" and f in ("js", "java", "csharp", "php", "c", "ruby"):
            return int(text[i + 1] not in (":", ")", ",", ";", "=", ">", "]", "[", ".", "{") and self._has_colon(i))
        return 0

    def _has_colon(self, i: int) -> bool:
        k, stop = i + 1, min(i + 400, self.n)
        while k < stop and self.text[k] not in (";", ")", "]", "}"):
            if self.text[k] == ":" or self.kind[k] == "s" and self.text[k].startswith(":"):
                return True
            k = self.mate[k] + 1 if self.text[k] in ("(", "[", "{") else k + 1
        return False

    # --- calls ---------------------------------------------------------------------------------------------

    def _start(self, k: int) -> tuple[int, bool]:
        """The first token of the operand that ends at ``k``, and whether there is a call or an index in it."""
        closed = False
        while True:
            while self.text[k] in (")", "]", "}") and self.mate[k] >= 0:
                closed = True
                k = self.mate[k]
                before = k - 1
                if before < 0 or self.text[k] == "{" or not (self.kind[before] == "w" and self.text[before] not in BEFORE_CALL | {"if", "while", "for", "switch", "match"} or self.text[before] in (")", "]")):
                    break
                k = before
            if k >= 2 and self.text[k - 1] in SEPARATORS[self.family] and (self.kind[k - 2] in ("w", "s", "n") or self.text[k - 2] in (")", "]", "}")):
                k -= 2
                continue
            return k, closed

    def _angle_open(self, i: int) -> int:
        """The ``<`` that a ``>`` at ``i`` closes as a list of types, else -1."""
        depth, k = 0, i
        while k >= 0 and i - k < 200:
            t = self.text[k]
            depth += (t == ">") - (t == "<")
            if not depth:
                return k if self.kind[k - 1] == "w" and self.tokens.end[k - 1] == self.tokens.at[k] else -1
            if t in (";", "(", ")", "&&", "||"):
                return -1
            k -= 1
        return -1

    def _angle_end(self, k: int) -> int:
        """The token after the list of types that begins at ``k``; ``k`` itself if it is none."""
        depth, i = 0, k
        while i < self.n and i - k < 2000:
            t = self.text[i]
            if t in ("(", "[", "{"):
                i = self.mate[i]
            depth += (t == "<") - (t == ">")
            if not depth:
                return i + 1
            if t == ";":
                break
            i += 1
        return k

    def _call(self, i: int, parent: str | None) -> None:
        text, f = self.text, self.family
        if f == "ruby":
            return self._ruby_call(i, parent)
        if text[i] != "(" or i == 0:
            return None
        j = i - 1
        if f == "js" and text[j] == ">" and (k := self._angle_open(j)) > 0:
            j = k - 1
        if self.kind[j] != "w" or text[j] in NOT_CALLED[f]:
            return None
        before = text[j - 1] if j else ""
        after = text[self.mate[i] + 1] if self.mate[i] < self.n else ""
        if f == "php":
            if before == "->":
                self._called(self._php_start(j), text[j], parent)
            elif before not in ("?->", "::", "new", "function", "&") and not text[j].startswith("$"):
                self._called(j, text[j], parent)
            return None
        first, closed = self._start(j)
        lead = text[first - 1] if first else ""
        if text[first] in ("{",) or lead in SEPARATORS[f] and lead != "::":
            return None
        if lead == "new" and not closed or lead == "@" or lead in ("function", "fn", "func", "def"):
            return None
        if lead == "new":
            first -= 1
        elif f == "js" and first == j:
            if lead == "*" and text[j - 2] == "function" or after == "{" and (lead in ("{", ",", "get", "set", "async", "static", "*") or self.tokens.fresh[j]):
                return None
        elif f == "rust":
            # In a pattern the name is that of a variant.
            if after in ("=>", "if", "|") and text[j][:1].isupper() or after == "=" and text[self._start(j)[0] - 1] in ("let", "|", "&"):
                return None
        elif f == "go" and lead == "]":
            return None
        elif f in ("c", "java", "csharp") and first > 0:
            # A name after a type is declared, not called.
            if self.kind[first - 1] == "w" and lead not in BEFORE_CALL or lead == ">" and self._angle_open(first - 1) >= 0:
                return None
            if f == "c" and parent is None and "=" not in text[max(first - 1, 0) : first]:
                return None
        self._called(first, self.tokens.slice(first, j), parent)
        return None

    def _php_start(self, j: int) -> int:
        k = j
        while k >= 2 and self.text[k - 1] in ("->", "::", "?->"):
            k -= 2
            while self.text[k] in (")", "]") and self.mate[k] > 0:
                k = self.mate[k] - 1
        return k

    # --- helpers for declarations ----------------------------------------------------------------------------

    def _find(self, k: int, end: int, wanted: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        """The first token from ``k`` with a wanted text outside of brackets, else -1."""
        while k < end:
            t = self.text[k]
            if t in wanted:
                return k
            if t in stop:
                return -1
            k = self.mate[k] + 1 if t in ("(", "[", "{") else k + 1
        return -1

    def _back(self, i: int, words: set[str]) -> int:
        while i > 0 and self.text[i - 1] in words:
            i -= 1
        return i

    def _body(self, brace: int, owner: str | None) -> int:
        """Queue the inside of a body; the token of its end."""
        end = min(self.mate[brace], self.n)
        self.work.append((brace + 1, end, owner))
        return end

    # --- JavaScript and TypeScript -----------------------------------------------------------------------------

    def _js_type(self, k: int, end: int) -> int:
        """The token after the type that begins at ``k``."""
        first = k
        while k < end:
            t = self.text[k]
            if t == "{" and k > first and self.text[k - 1] not in ("|", "&", "=>", "<", ",", ":", "keyof", "extends", "is"):
                return k
            if t in (";", "=", ",", ")", "}", "]") or k > first and self.tokens.fresh[k] and self.text[k - 1] not in ("|", "&", "=>", "<", ",") and t not in ("|", "&", "=>", "[", ">", "{"):
                return k
            k = self.mate[k] + 1 if t in ("(", "[", "{") else self._angle_end(k) if t == "<" else k
            k += t not in ("(", "[", "{", "<") or (t == "<" and self._angle_end(k) == k)
        return k

    def _js_end(self, k: int, end: int) -> int:
        """The token after the expression that begins at ``k``."""
        first = k
        while k < end:
            t = self.text[k]
            if t in (",", ";", ")", "]", "}"):
                return k
            if k > first and self.tokens.fresh[k]:
                before = self.text[k - 1]
                ends = self.kind[k - 1] != "p" or before in (")", "]", "}", "++", "--", "!")
                goes_on = self.kind[k] == "p" and t not in ("{", "[", "(", "@", "#", "!", "++", "--") or t in ("instanceof", "in", "as", "satisfies")
                if ends and not goes_on:
                    return k
            k = self.mate[k] + 1 if t in ("(", "[", "{") else k + 1
        return k

    def _js_function(self, v: int, end: int) -> bool:
        """Whether the value at ``v`` is an arrow function or a function expression."""
        text, v = self.text, v + (self.text[v] == "async")
        if text[v] == "function" or self.kind[v] == "w" and text[v + 1] == "=>":
            return text[v + 1] != "*"
        if text[v] == "<":
            v = self._angle_end(v)
        if text[v] != "(":
            return False
        m = self.mate[v]
        if m >= self.n:
            return False
        return text[m + 1] == "=>" or text[m + 1] == ":" and self._find(m + 2, min(end, m + 200), ("=>",), (";", ",", "=")) > 0

    def _js_exported(self, first: int) -> bool:
        k = first - 1
        while k > 0 and self.text[k] in ("default", "declare"):
            k -= 1
        return k >= 0 and self.text[k] == "export"

    def _decorators(self, first: int) -> tuple[str, ...]:
        """Decorators that end just before ``first``, and before the words of an export."""
        out: list[str] = []
        k = self._back(first, {"export", "default", "declare", "abstract"}) - 1
        while k > 0:
            e, s = k, k
            if self.text[s] == ")" and self.mate[s] > 0:
                s = self.mate[s] - 1
            while s >= 2 and self.text[s - 1] == ".":
                s -= 2
            if s < 1 or self.text[s - 1] != "@":
                break
            out.append(self.tokens.slice(s - 1, e))
            k = s - 2
        return tuple(out[::-1])

    def _js(self, i: int, end: int, parent: str | None) -> int | None:
        text, kind = self.text, self.kind
        t = text[i]
        if kind[i] != "w" or t not in ("function", "class", "interface", "enum", "type", "const", "let", "var", "import", "export"):
            return None
        before = text[i - 1] if i else ""
        if before in IN_EXPRESSION and not (before == "(" and t in ("const", "let", "var")) and not (before in ("*", "/") and self.tokens.fresh[i]):
            return None
        if t == "import":
            return self._js_end(i + 1, end) if text[i + 1] not in ("(", ".") else None
        if t == "export":
            stop = self.mate[i + 1] + 1 if text[i + 1] == "{" else i + 2 if text[i + 1] == "*" else None
            return self._js_end(stop, end) if stop and stop < end and text[stop] in ("from", "as") else stop
        if t == "function":
            j = i + 1 + (text[i + 1] == "*")
            if kind[j] != "w":
                return None
            k = self._angle_end(j + 1) if text[j + 1] == "<" else j + 1
            if text[k] != "(" or self.mate[k] >= self.n:
                return None
            m = r = self.mate[k]
            returns = None
            if text[m + 1] == ":":
                r = self._js_type(m + 2, end) - 1
                returns = self.tokens.slice(m + 2, r) if r > m + 1 else None
            if text[r + 1] != "{":
                return r + 1
            first = self._back(i, {"async"})
            last = min(self.mate[r + 1], self.n)
            name = self._symbol("function", text[j], parent, first, last, signature=self.tokens.slice(k, m), returns=returns, exported=self._js_exported(first))
            self.work.append((k + 1, last, name))
            return last + 1
        if t == "class":
            if kind[i + 1] != "w" or text[i + 1] in ("extends", "implements"):
                return None
            brace = self._js_class_body(i + 2, end)
            if brace < 0:
                return None
            first = self._back(i, {"abstract"})
            name = self._symbol("class", text[i + 1], parent, first, self.mate[brace], exported=self._js_exported(first), decorators=self._decorators(first))
            self._js_members(brace, name)
            return self.mate[brace] + 1
        if t in ("interface", "enum"):
            brace = self._find(i + 2, end, ("{",), (";", "=", ")")) if kind[i + 1] == "w" and text[i + 2] in ("{", "extends", "<") else -1
            if brace < 0:
                return None
            first = self._back(i, {"const"}) if t == "enum" else i
            self._symbol(t, text[i + 1], parent, first, self.mate[brace], exported=self._js_exported(first))
            return self.mate[brace] + 1
        if t == "type":
            equals = i + 2 if text[i + 2] == "=" else self._angle_end(i + 2) if text[i + 2] == "<" else -1
            if kind[i + 1] != "w" or equals < 0 or text[equals] != "=":
                return None
            stop = self._js_end(equals + 1, end)
            self._symbol("type", text[i + 1], parent, i, stop if text[stop] == ";" else stop - 1, exported=self._js_exported(i))
            return stop
        return self._js_variables(i, end, parent)

    def _js_class_body(self, k: int, end: int) -> int:
        while k < end and self.text[k] != "{":
            k = self._angle_end(k) if self.text[k] == "<" and self._angle_end(k) > k else self.mate[k] + 1 if self.text[k] in ("(", "[") else k + 1
        return k if k < end and self.mate[k] <= self.n else -1

    def _js_variables(self, i: int, end: int, parent: str | None) -> None:
        """Note the functions that a declaration binds; its other values are read on as they stand."""
        text, j, found = self.text, i + 1, []
        while j < end:
            name = text[j] if self.kind[j] == "w" else None
            j = self.mate[j] + 1 if text[j] in ("{", "[") else j + 1
            j += text[j] == "!"
            if text[j] == ":":
                j = self._find(j + 1, end, ("=", ",", ";", ")"), ("in", "of"))
            if j < 0 or text[j] != "=":
                stop = j
            else:
                stop = self._js_end(j + 1, end)
                if name and self._js_function(j + 1, end):
                    found.append((name, j + 1, stop))
            if stop < 0 or stop >= end or text[stop] != ",":
                break
            j = stop + 1
        if found:
            last = stop if text[stop] == ";" else stop - 1
            for name, a, b in found:
                qualified = self._symbol("variable", name, parent, i, last, exported=self._js_exported(i))
                self.work.append((a, b, qualified))
                self.jump[a] = b

    def _js_members(self, brace: int, owner: str) -> None:
        text, kind, j, end = self.text, self.kind, brace + 1, min(self.mate[brace], self.n)
        while j < end:
            decorators = []
            while text[j] == "@":
                k = j + 2
                while text[k] == ".":
                    k += 2
                k = self.mate[k] + 1 if text[k] == "(" else k
                decorators.append(self.tokens.slice(j, k - 1))
                j = k
            first = j
            while text[j] in MODIFIERS["js"] and text[j + 1] not in ("(", "=", ";", ":", "?", "}", "<", "!"):
                j += 1
            j += text[j] == "*"
            if text[j] == "[" and self.mate[j] < end:
                name, k = self.tokens.slice(j, self.mate[j]), self.mate[j] + 1
            else:
                name, k = text[j], j + 1
            k += text[k] in ("?", "!")
            k = self._angle_end(k) if text[k] == "<" else k
            if text[k] == "(" and kind[j] != "p" or text[j] == "[" and text[k] == "(":
                m, returns = self.mate[k], None
                r = m + 1
                if text[r] == ":":
                    r = self._js_type(m + 2, end)
                    returns = self.tokens.slice(m + 2, r - 1)
                if text[r] == "{":
                    signature = self.tokens.slice(k, m)
                    qualified = self._symbol("method", name, owner, first, self.mate[r], signature=signature, returns=returns, receiver=owner, decorators=tuple(decorators))
                    j = self._body(r, qualified) + 1
                else:
                    j = r + 1
            else:
                k = j if text[j] != "{" else self.mate[j] + 1
                j = max(self._js_end(k, end), first) + 1 if text[k] not in ("}",) else k + 1
                # A field without a semicolon ends before the next member's first token.
                if j <= end and text[j - 1] not in (";", ",", "}", ")") and self.tokens.fresh[j - 1] and j - 1 > first:
                    j -= 1

    # --- Rust --------------------------------------------------------------------------------------------------

    def _macro(self, i: int) -> bool:
        return self.kind[i] == "w" and i + 2 < self.n and self.text[i + 1] == "!" and self.text[i + 2] in ("(", "[", "{")

    def _rust_head(self, i: int) -> tuple[int, list[str]]:
        """The first token of an item whose keyword is at ``i``, and the attributes before it."""
        text = self.text
        while i > 0:
            if text[i - 1] in MODIFIERS["rust"] or self.kind[i - 1] == "s" and i > 1 and text[i - 2] == "extern":
                i -= 1
            elif text[i - 1] == ")" and self.mate[i - 1] > 0 and text[self.mate[i - 1] - 1] == "pub":
                i = self.mate[i - 1]
            else:
                break
        out, k = [], i
        while k > 1 and text[k - 1] == "]" and self.mate[k - 1] > 0 and text[self.mate[k - 1] - 1] == "#":
            out.append(self.tokens.slice(self.mate[k - 1] - 1, k - 1))
            k = self.mate[k - 1] - 1
        return i, out

    def _rust_function(self, i: int, end: int, owner: str | None, kind: str) -> int | None:
        text = self.text
        k = self._angle_end(i + 2) if text[i + 2] == "<" else i + 2
        if self.kind[i + 1] != "w" or text[k] != "(" or self.mate[k] >= self.n:
            return None
        m = self.mate[k]
        stop = self._find(m + 1, end, ("{", ";", "where"))
        brace = self._find(m + 1, end, ("{", ";"))
        if brace < 0:
            return None
        returns = self.tokens.slice(m + 2, stop - 1) if text[m + 1] == "->" else None
        first, attributes = self._rust_head(i)
        exported = text[first] == "pub" and text[first + 1] != "("
        if kind == "function":
            exported |= any("#[test" in a or "#[tokio::test" in a for a in attributes)
        elif kind == "impl":
            exported |= bool(attributes)
        whole = text[brace] == "{"
        if not whole and kind == "function":
            return brace + 1
        receiver = owner if kind != "function" else None
        qualified = self._symbol("function" if kind == "function" else "method", text[i + 1], owner, first, self.mate[brace] if whole else brace, signature=self.tokens.slice(k, m), returns=returns, receiver=receiver, exported=exported, complexity=None if whole else 1)
        return (self._body(brace, qualified) if whole else brace) + 1

    def _rust(self, i: int, end: int, parent: str | None) -> int | None:
        text, kind = self.text, self.kind
        t = text[i]
        if t == "#" and text[i + 1] in ("[", "!"):
            open_ = i + 1 + (text[i + 1] == "!")
            return self.mate[open_] + 1 if text[open_] == "[" else None
        if kind[i] != "w":
            return None
        if t == "macro_rules" and text[i + 1] == "!":
            return self.mate[i + 3] + 1 if text[i + 3] in ("{", "(", "[") else None
        if self._macro(i):
            return self.mate[i + 2] + 1
        if t == "fn":
            return self._rust_function(i, end, parent, "function")
        if t == "use":
            stop = self._find(i + 1, end, (";",))
            return stop + 1 if stop > 0 else None
        if t in ("struct", "enum", "trait") and kind[i + 1] == "w":
            stop = self._find(i + 2, end, ("{", ";"))
            if stop < 0:
                return None
            last = self.mate[stop] if text[stop] == "{" else stop
            first, _ = self._rust_head(i)
            exported = text[first] == "pub" and text[first + 1] != "("
            name = self._symbol("enum" if t == "enum" else "class", text[i + 1], parent, first, last, exported=exported)
            if t == "trait" and text[stop] == "{":
                self._rust_members(stop, name, "trait")
            return last + 1
        if t == "impl" and (not i or text[i - 1] not in ("->", ":", "(", ",", "<", "&", "=", "+")):
            brace = self._find(i + 1, end, ("{",), (";",))
            if brace < 0:
                return None
            k = self._angle_end(i + 1) if text[i + 1] == "<" else i + 1
            stop = self._find(k, brace, ("where",))
            stop = brace if stop < 0 else stop
            of = next((j for j in range(k, stop) if text[j] == "for" and text[j + 1] != "<"), -1)
            of = of + 1 if of > 0 else k
            if of < stop:
                self._rust_members(brace, f"{self.path}.{self.tokens.slice(of, stop - 1)}", "impl")
            return self.mate[brace] + 1
        return None

    def _rust_members(self, brace: int, owner: str, kind: str) -> None:
        j, end = brace + 1, min(self.mate[brace], self.n)
        while j < end:
            after = None
            if self.text[j] == "fn":
                after = self._rust_function(j, end, owner, kind)
            elif self._macro(j):
                after = self.mate[j + 2] + 1
            elif self.text[j] in ("(", "[", "{"):
                after = self.mate[j] + 1
            j = max(after or 0, j + 1)

    # --- Go ------------------------------------------------------------------------------------------------------

    def _go(self, i: int, end: int, parent: str | None) -> int | None:
        text, kind = self.text, self.kind
        t = text[i]
        if t == "import" and kind[i] == "w":
            return self.mate[i + 1] + 1 if text[i + 1] == "(" else i + 2 + (kind[i + 1] == "w" or text[i + 1] == ".")
        if t == "func" and kind[i] == "w":
            receiver, j = None, i + 1
            if text[j] == "(" and self.tokens.fresh[i]:
                m = self.mate[j]
                if m < self.n and kind[m + 1] == "w" and text[m + 2] in ("(", "["):
                    names = j + 1 + (kind[j + 1] == "w" and text[j + 2] not in (")", "[", "."))
                    receiver = self.tokens.slice(names, m - 1).lstrip("* ") if names < m else ""
                    j = m + 1
            if kind[j] != "w":
                return None
            k = self.mate[j + 1] + 1 if text[j + 1] == "[" else j + 1
            if text[k] != "(" or self.mate[k] >= self.n:
                return None
            m = r = self.mate[k]
            while r + 1 < end and not self.tokens.fresh[r + 1] and text[r + 1] != "{":
                r += 1
                r = self.mate[r + 1] if text[r] in ("interface", "struct") and text[r + 1] == "{" else self.mate[r] if text[r] in ("(", "[") else r
            whole = r + 1 < end and text[r + 1] == "{"
            returns = self.tokens.slice(m + 1, r) if r > m else None
            owner = parent if receiver is None else f"{self.path}.{receiver}" if receiver else None
            last = self.mate[r + 1] if whole else r
            kind_ = "function" if receiver is None else "method"
            qualified = self._symbol(kind_, text[j], owner, i, last, signature=self.tokens.slice(k, m), returns=returns, receiver=receiver, exported=text[j][:1].isupper())
            return (self._body(r + 1, qualified) if whole else r) + 1
        if t == "type" and kind[i] == "w" and self.tokens.fresh[i]:
            if text[i + 1] != "(":
                return self._go_type(i + 1, i + 1)
            j, stop = i + 2, min(self.mate[i + 1], self.n)
            while j < stop:
                j = max(self._go_type(j, j) or 0, j + 1)
            return stop + 1
        return None

    def _go_type(self, j: int, first: int) -> int | None:
        text = self.text
        if self.kind[j] != "w" or text[j + 1] == "=":
            return None
        k = j + 1
        if text[k] == "[" and self.kind[k + 1] == "w" and self.mate[k] > k + 2 and self.mate[k] < self.n:
            k = self.mate[k] + 1
        brace = k + 1 if text[k] in ("struct", "interface") and text[k + 1] == "{" else -1
        last = k
        if brace > 0:
            last = min(self.mate[brace], self.n - 1)
        else:
            while last + 1 < self.n and not self.tokens.fresh[last + 1] and text[last + 1] not in (";", ")"):
                last = self.mate[last + 1] if text[last + 1] in ("(", "[", "{") else last + 1
        kind = {"struct": "class", "interface": "interface"}.get(text[k], "type")
        self._symbol(kind, text[j], None, first, last, exported=text[j][:1].isupper(), complexity=1)
        return last + 1

    # --- Java and C# -----------------------------------------------------------------------------------------------

    def _jvm(self, i: int, end: int, parent: str | None) -> int | None:
        text = self.text
        t = text[i]
        if t == "@" and self.kind[i + 1] == "w" and text[i + 1] != "interface":
            k = i + 2
            while text[k] == ".":
                k += 2
            return self.mate[k] + 1 if text[k] == "(" else k
        if t in ("using", "import", "package") and self.tokens.fresh[i] and parent is None:
            stop = self._find(i + 1, end, (";",))
            return stop + 1 if stop > 0 and text[i + 1] != "(" else None
        if t == "[" and self.family == "csharp" and self.tokens.fresh[i] and parent is None:
            return self.mate[i] + 1
        if t not in ("class", "interface", "enum") or self.kind[i + 1] != "w" or i and text[i - 1] in (".", "@", ":", ",", "record"):
            return None
        brace = self._find(i + 2, end, ("{",), (";",))
        if brace < 0:
            return None
        name = self._symbol(t, text[i + 1], parent, self._jvm_first(i), self.mate[brace])
        if t != "enum":
            self._jvm_members(brace, name)
        return self.mate[brace] + 1

    def _jvm_first(self, i: int) -> int:
        """Modifiers, annotations and attributes belong to a declaration."""
        while i > 0:
            t = self.text[i - 1]
            if t in MODIFIERS["jvm"]:
                i -= 1
            elif self.kind[i - 1] == "w" and i > 1 and self.text[i - 2] == "@":
                i -= 2
            elif t == ")" and self.mate[i - 1] > 1 and self.text[self.mate[i - 1] - 2] == "@":
                i = self.mate[i - 1] - 2
            elif t == "]" and self.family == "csharp" and self.mate[i - 1] >= 0 and self.tokens.fresh[self.mate[i - 1]]:
                i = self.mate[i - 1]
            else:
                break
        return i

    def _jvm_members(self, brace: int, owner: str) -> None:
        text, j, end = self.text, brace + 1, min(self.mate[brace], self.n)
        while j < end:
            first = j
            while text[j] == "@" and text[j + 1] != "interface" or text[j] == "[" and self.family == "csharp":
                k = j + 2 if text[j] == "@" else self.mate[j] + 1
                while text[j] == "@" and text[k] == ".":
                    k += 2
                j = self.mate[k] + 1 if text[j] == "@" and text[k] == "(" else k
            k = j
            while k < end and text[k] not in ("{", ";", "=", "=>") and not (text[k] == "(" and (self.kind[k - 1] == "w" and text[k - 1] not in MODIFIERS["jvm"] or text[k - 1] == ">" and k > j)):
                k = self.mate[k] + 1 if text[k] in ("(", "[") else self._angle_end(k) if text[k] == "<" and self._angle_end(k) > k else k + 1
            head = text[j:k]
            if any(x in head for x in ("class", "interface", "enum", "struct", "record")) and text[k] != "=":
                k = self._find(k, end, ("{", ";"))
                j = (self.mate[k] if k > 0 and text[k] == "{" else k if k > 0 else end) + 1
            elif k >= end:
                break
            elif text[k] == "(":
                name = k - 1
                if text[name] == ">":
                    name = self._angle_open(name) - 1
                m = self.mate[k]
                r = self._find(m + 1, end, ("{", ";", "=>", "="))
                r = end if r < 0 else r
                last = self.mate[r] if text[r] == "{" else r if text[r] == ";" else self._find(r, end, (";",))
                last = min(last if last > 0 else end, end)
                plain = name > 0 and self.kind[name] == "w" and not any(x in head for x in ("delegate", "operator", "event", "~", "implicit", "explicit"))
                if plain:
                    qualified = self._symbol("method", text[name], owner, first, last, signature=self.tokens.slice(k, m), receiver=owner, complexity=None if text[r] in ("{", "=>") else 1)
                    if text[r] == "{":
                        self._body(r, qualified)
                j = last + 1
            elif text[k] == "{":
                j = self.mate[k] + 1
            elif text[k] == ";":
                j = k + 1
            else:
                stop = self._find(k, end, (";",))
                j = stop + 1 if stop > 0 else end

    # --- PHP ---------------------------------------------------------------------------------------------------------

    def _php_function(self, i: int, end: int) -> tuple[int, int, int, int] | None:
        """(name, opening and closing parenthesis, body or semicolon) of a ``function`` at ``i``."""
        j = i + 1 + (self.text[i + 1] == "&")
        if self.kind[j] != "w" or self.text[j + 1] != "(" or self.mate[j + 1] >= self.n:
            return None
        stop = self._find(self.mate[j + 1] + 1, end, ("{", ";"))
        return (j, j + 1, self.mate[j + 1], stop) if stop > 0 else None

    def _php(self, i: int, end: int, parent: str | None) -> int | None:
        text = self.text
        t = text[i]
        if t == "#" and text[i + 1] == "[":
            return self.mate[i + 1] + 1
        if t == "use" and self.tokens.fresh[i]:
            stop = self._find(i + 1, end, (";",))
            return stop + 1 if stop > 0 else None
        if t == "function" and (found := self._php_function(i, end)):
            j, k, m, stop = found
            returns = self.tokens.slice(m + 2, stop - 1) if text[m + 1] == ":" else None
            whole = text[stop] == "{"
            qualified = self._symbol("function", text[j], parent, i, self.mate[stop] if whole else stop, signature=self.tokens.slice(k, m), returns=returns)
            return (self._body(stop, qualified) if whole else stop) + 1
        if t in ("class", "interface", "trait") and self.kind[i + 1] == "w" and (not i or text[i - 1] not in ("::", "new", "->")):
            brace = self._find(i + 2, end, ("{",), (";",))
            if brace < 0:
                return None
            name = self._symbol("interface" if t == "interface" else "class", text[i + 1], parent, self._back(i, MODIFIERS["php"]), self.mate[brace])
            j, stop = brace + 1, min(self.mate[brace], self.n)
            while j < stop:
                if text[j] == "function" and (found := self._php_function(j, stop)):
                    f, k, m, r = found
                    whole = text[r] == "{"
                    qualified = self._symbol("method", text[f], name, self._back(j, MODIFIERS["php"]), self.mate[r] if whole else r, signature=self.tokens.slice(k, m), receiver=name)
                    j = (self._body(r, qualified) if whole else r) + 1
                else:
                    j = self.mate[j] + 1 if text[j] in ("(", "[", "{") else j + 1
            return stop + 1
        return None

    # --- C and C++ -----------------------------------------------------------------------------------------------------

    def _c_body(self, m: int, end: int) -> int:
        """The brace of the body behind the parameters that end at ``m``, else -1."""
        text, r = self.text, m + 1
        while r < end:
            t = text[r]
            if t == "{":
                return r
            if t == "->":
                return self._find(r, end, ("{",), (";",))
            if t == ":":  # what a constructor sets before its body
                r += 1
                while r < end:
                    k = self._find(r, end, ("(", "{"), (";",))
                    if k < 0:
                        return -1
                    r = self.mate[k] + 1
                    if text[r] != ",":
                        return r if text[r] == "{" else -1
                    r += 1
                return -1
            if self.kind[r] == "w" and text[r + 1] == "(" and (t in ("noexcept", "throw") or t.startswith("__")):
                r = self.mate[r + 1] + 1
            elif t in ("const", "noexcept", "override", "final", "volatile", "&", "&&", "try", "mutable") or t in ("[", "]"):
                r += 1
            else:
                return -1
        return -1

    def _c_function(self, i: int, end: int, owner: str | None, method: bool) -> int | None:
        """A definition whose parameters open at ``i``; the token after it."""
        text, kind = self.text, self.kind
        j = i - 1
        name = text[j]
        if name == "operator" and text[i + 1] == ")" and text[i + 2] == "(":
            i, name = i + 2, "operator()"
        elif j > 0 and text[j - 1] == "operator":
            name, j = "operator" + name, j - 1
        elif kind[j] != "w" or name in NOT_CALLED["c"] - {"operator"} or j < 0:
            return None
        if self.mate[i] >= self.n:
            return None
        brace = self._c_body(self.mate[i], end)
        if brace < 0:
            return None
        if text[j - 1] == "~":
            name, j = "~" + name, j - 1
        receiver = owner if method else None
        first = j
        while first >= 2 and text[first - 1] == "::" and kind[first - 2] == "w":
            first -= 2
        if first < j and not method:
            receiver = f"{self.path}.{'.'.join(text[first : j - 1 : 2])}"
        while first > 0 and (kind[first - 1] in ("w", "n", "s") or text[first - 1] in ("*", "&", "&&", "::", "<", ">", ",", "[", "]")):
            if text[first - 1] == ">" and (open_ := self._angle_open(first - 1)) > 0 and text[open_ - 1] == "template":
                break
            first -= 1
        qualified = self._symbol("method" if method else "function", name, owner, first, self.mate[brace], receiver=receiver)
        return self._body(brace, qualified) + 1

    def _c(self, i: int, end: int, parent: str | None) -> int | None:
        text = self.text
        t = text[i]
        if t == "template" and text[i + 1] == "<":
            return self._angle_end(i + 1)
        if t in ("struct", "union", "class", "enum") and (t != "class" or self.language == "cpp"):
            j = i + 1 + (t == "enum" and text[i + 1] in ("class", "struct"))
            if self.kind[j] != "w":
                return None
            brace = j + 1 + (text[j + 1] == "final")
            if text[brace] == ":":
                brace = self._find(brace, end, ("{",), (";", ")", "="))
            if brace < 0 or text[brace] != "{":
                return None
            name = self._symbol("enum" if t == "enum" else "class", text[j], parent, i, self.mate[brace])
            if t != "enum" and self.language == "cpp":
                self._c_members(brace, name)
            return self.mate[brace] + 1
        if t == "(" and parent is None:
            return self._c_function(i, end, None, False)
        if t == "{" and parent is None and i and text[i - 1] in ("=", ",", "(", "return"):
            return self.mate[i] + 1
        return None

    def _c_members(self, brace: int, owner: str) -> None:
        j, end = brace + 1, min(self.mate[brace], self.n)
        while j < end:
            after = None
            if self.text[j] == "template" and self.text[j + 1] == "<":
                after = self._angle_end(j + 1)
            elif self.text[j] == "(":
                after = self._c_function(j, end, owner, True) or self.mate[j] + 1
            elif self.text[j] in ("{", "["):
                after = self.mate[j] + 1
            j = max(after or 0, j + 1)

    # --- Ruby ------------------------------------------------------------------------------------------------------------

    def _block_ends(self) -> dict[int, int]:
        """The ``end`` of each word that opens a block."""
        text, kind, open_, out, loop = self.text, self.kind, [], {}, -1
        leads = set("= ( [ { ; , | && || ! => -> + << += ||= then do else begin and or not elsif when in ensure return".split())
        for i in range(self.n):
            t = text[i]
            if kind[i] != "w" or i and text[i - 1] in (".", "::", "&", "def") or text[i + 1] == ":" and self.tokens.end[i] == self.tokens.at[i + 1]:
                continue
            begins = self.tokens.fresh[i] or not i or text[i - 1] in leads
            if t in ("class", "module", "def", "begin", "case") or t in ("if", "unless", "while", "until", "for") and begins:
                if t == "def":
                    k = i + 2 + 2 * (text[i + 2] in (".", "::"))
                    k = self.mate[k] + 1 if text[k] == "(" else k
                    if text[k] == "=" and not self.tokens.fresh[k]:
                        continue  # a method in one line, without an end
                open_.append(i)
                if t in ("while", "until", "for"):
                    loop = self.tokens.line[i]
            elif t == "do":
                if loop == self.tokens.line[i]:
                    loop = -1
                else:
                    open_.append(i)
            elif t == "end" and open_:
                out[open_.pop()] = i
        return out

    def _ruby_method(self, i: int, owner: str | None, kind: str) -> int:
        name, last = i + 1, self.ends.get(i)
        k = name + 1
        k = self.mate[k] + 1 if self.text[k] == "(" and not self.tokens.fresh[k] else k
        if last is None:  # in one line
            last = k
            while last + 1 < self.n and not self.tokens.fresh[last + 1]:
                last += 1
        elif self.text[name + 1] != "(":
            while k < last and not self.tokens.fresh[k] and self.text[k] != ";":
                k += 1
        qualified = self._symbol(kind, self.text[name], owner, i, last, receiver=owner if kind == "method" else None)
        self.work.append((k, last + (self.ends.get(i) is None), qualified))
        return last + 1

    def _ruby(self, i: int, end: int, parent: str | None) -> int | None:
        text = self.text
        t = text[i]
        if self.kind[i] != "w" or i and text[i - 1] in (".", "::"):
            return None
        if t == "def":
            if text[i + 2] in (".", "::"):
                return i + 4  # of an object: no symbol, its calls belong to what is around it
            return self._ruby_method(i, None, "function") if parent is None and self.kind[i + 1] == "w" else i + 2
        if t in ("class", "module") and i in self.ends and self.kind[i + 1] == "w":
            j = i + 1
            while text[j + 1] == "::":
                j += 2
            name = self._symbol("class", self.tokens.slice(i + 1, j), parent, i, self.ends[i])
            k, last = j + 1, self.ends[i]
            while k < last:
                if text[k] == "def" and text[k - 1] not in (".", "::"):
                    if text[k + 2] in (".", "::"):
                        k = self.ends.get(k, k) + 1
                    else:
                        k = self._ruby_method(k, name, "method")
                elif k in self.ends and self.kind[k] == "w":
                    k = self.ends[k] + 1
                else:
                    k += 1
            return last + 1
        return None

    def _ruby_call(self, i: int, parent: str | None) -> None:
        text, kind = self.text, self.kind
        t = text[i]
        if kind[i] != "w" or not (t[0].islower() or t[0] == "_"):
            return
        before = text[i - 1] if i else ""
        if before in (".", "&.") or before == "::":
            k = i - 2 - (i > 2 and text[i - 2] == "&")
            while text[k] in (")", "]", "}") and self.mate[k] > 0:
                k = self.mate[k] - (kind[self.mate[k] - 1] == "w")
            while k >= 2 and text[k - 1] in (".", "::"):
                k -= 2
            self._called(max(k, 0), t, parent)
            return
        if t in NOT_CALLED["ruby"] or before in ("def", "alias", "undef", "class", "module") or i + 1 >= self.n:
            return
        after, spaced, same = text[i + 1], self.tokens.end[i] < self.tokens.at[i + 1], not self.tokens.fresh[i + 1]
        argument = same and spaced and (kind[i + 1] in ("s", "n") or kind[i + 1] == "w" and after not in NOT_CALLED["ruby"] - {"self", "nil", "true", "false", "defined?"} or after in ("->", "::", "!") or after in ("[", "*", "&", "-") and self.tokens.end[i + 1] == self.tokens.at[i + 2] and after != "[")
        if after == "(" and not spaced or argument or same and (after == "do" and before not in ("while", "until", "in") or after == "{" and before not in ("|", "->")):
            self._called(i, t, parent)


def broken_python(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Classes, functions and calls of a Python file with errors, by indentation."""
    plain = re.sub(r"'''(?:.|\n)*?'''|\"\"\"(?:.|\n)*?\"\"\"|#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    lines = plain.split("\n")
    symbols, calls, open_ = [], [], []
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        outer = open_[-1] if open_ else None
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)\s*(\([^)]*\))?", line):
            kind = "class" if m[1] == "class" else "method" if outer and outer[1]["kind"] == "class" else "function"
            qualified = f"{outer[1]['qualified_name'] if outer else path}.{m[2]}"
            symbols.append({
                "kind": kind, "name": m[2], "qualified_name": qualified, "line_start": n, "line_end": n, "signature": None if kind == "class" else m[3], "return_type": None,
                "receiver_type": outer[1]["qualified_name"] if kind == "method" else None, "is_exported": False, "complexity": 0 if kind == "class" else 1, "decorators": [],
            })
            open_.append((indent, symbols[-1]))
        else:
            for _, s in open_:
                s["line_end"] = n
                if s["kind"] != "class":
                    s["complexity"] += len(re.findall(r"\b(?:if|elif|for|while|case|and|or)\b", line))
            caller = outer[1]["qualified_name"] if outer and outer[1]["kind"] != "class" else None
            for m in re.finditer(r"(?<![\w.@])([^\W\d]\w*(?:\.[^\W\d]\w*)*)\(", line):
                if m[1] not in ("if", "elif", "while", "for", "return", "not", "and", "or", "in", "is", "lambda", "assert", "del", "yield", "await", "with", "except", "raise"):
                    calls.append({"callee": m[1], "line": n, "col": m.start(), "caller_qualified": caller})
    return symbols, calls


def extract(path: str, language: str, text: str) -> dict:
    """Symbols, calls and imports of a file."""
    if language == "python":
        symbols, calls = broken_python(path, text)
        return {"symbols": symbols, "calls": calls, "imports": imports_of(language, text)}
    outline = Outline(path, language, text)
    code = outline.tokens.code()
    if language == "php":  # what a class uses are traits
        lines = code.split("\n")
        for s in outline.symbols:
            if s["kind"] == "class":
                lines[s["line_start"] : s["line_end"] - 1] = [""] * max(s["line_end"] - 1 - s["line_start"], 0)
        code = "\n".join(lines)
    return {"symbols": outline.symbols, "calls": outline.calls, "imports": imports_of(language, code)}
