"""Intents of Go and TypeScript functions, from the tokens of a file.

Functions, branches, statements and calls are found by brackets and by where statements end; conditions are read by a small
expression grammar, and those that have anything else in them keep their text only. Functions inside functions are no branches of
the outer one, but their calls and failures count there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from .effects import call_effect, is_verb

TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|[ \t\r]+)|(?P<nl>\n)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>0[xXbBoO][0-9A-Fa-f_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w$]*|[$#][\w$]*)"""
    r"""|(?P<mark>===|!==|\.\.\.|=>|&&|\|\||<=|>=|==|!=|:=|<-|\?\.|\?\?|\+\+|--|.)""",
    re.S,
)
OPEN, CLOSE = "([{", ")]}"
#: Words that are constants, calls that have no effect, marks of sentinels.
CONSTANTS = {"go": ["nil", "true", "false", "iota"], "typescript": ["true", "false", "null"]}
PURE = {
    "go": (["strings", "strconv", "math", "unicode", "utf8", "errors", "sort", "bytes", "regexp"], ["fmt.Errorf", "fmt.Sprintf", "fmt.Sprint", "fmt.Sprintln"]),
    "typescript": (["JSON", "Math", "Object", "Array", "Number", "String"], []),
}
SENTINEL = re.compile(r"^Err[A-Z0-9_]")
COMPARE = ["<", "<=", ">", ">=", "==", "!=", "===", "!=="]
#: Words before a bracket that make it no call.
NO_CALL = {"if", "for", "switch", "func", "function", "return", "catch", "while", "typeof", "range", "select", "case", "map", "chan", "interface", "struct", "throw", "await", "in", "of", "new", "else", "go", "defer", "yield", "async", "do", "with", "var", "let", "const", "type"}


REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*")
BEFORE_REGEX = ["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"]


def template_end(text: str, at: int) -> int:
    """Where the template literal that begins at `at` ends; templates may stand in its substitutions."""
    k, depth = at + 1, 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif depth == 0 and c == "`":
            return k + 1
        elif depth == 0 and text.startswith("${", k):
            depth, k = 1, k + 1
        elif depth and c == "`":
            k = template_end(text, k) - 1
        elif depth and c in "\"'":
            m = TOKEN.match(text, k)
            k = m.end() - 1 if m and m.lastgroup == "string" else k
        elif depth:
            depth += (c == "{") - (c == "}")
        k += 1
    return len(text)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    first: bool  # first of its line


class Source:
    """The tokens of a text, and for each bracket the place of the other one."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.go = text, language, language == "go"
        self.t: list[Token] = []
        line, first, at = 1, True, 0
        while m := TOKEN.match(text, at):
            kind, at = m.lastgroup, m.end()
            if not self.go and m.group() == "/" and self._regex_may_begin() and (r := REGEX.match(text, m.start())):
                kind, at = "string", r.end()
            elif not self.go and text[m.start()] == "`":
                kind, at = "string", template_end(text, m.start())
            if kind == "nl":
                first = True
            elif kind != "skip":
                self.t.append(Token(kind, text[m.start() : at], m.start(), at, line, first))
                first = False
            line += text.count("\n", m.start(), at)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, x in enumerate(self.t):
            if x.kind == "mark" and x.text in OPEN:
                stack.append(k)
            elif x.kind == "mark" and x.text in CLOSE and stack and OPEN.index(self.t[stack[-1]].text) == CLOSE.index(x.text):
                self.match[k], self.match[stack.pop()] = stack[-1], k

    def _regex_may_begin(self) -> bool:
        """Whether a slash after the last token begins a pattern, not a division."""
        if not self.t:
            return True
        x = self.t[-1]
        return x.text in BEFORE_REGEX if x.kind == "word" else x.kind == "mark" and x.text not in (")", "]", "}", "++", "--")

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind != "string" and self.t[k].text in texts

    def words(self, a: int, b: int) -> str:
        """The text of tokens a to b - 1 with single spaces."""
        return " ".join(self.text[self.t[a].start : self.t[b - 1].end].split()) if a < b else ""

    def split(self, a: int, b: int, mark: str) -> list[tuple[int, int]]:
        """Parts of tokens a to b - 1 between marks outside brackets."""
        parts, start, k = [], a, a
        while k < b:
            if self.is_(k, mark):
                parts.append((start, k))
                start = k + 1
            k = self.match[k] if k in self.match and self.match[k] > k else k
            k += 1
        parts.append((start, b))
        return [p for p in parts if p[0] < p[1]]

    def find(self, a: int, b: int, *marks: str) -> int:
        """The first of the marks outside brackets; b without one."""
        k = a
        while k < b and not self.is_(k, *marks):
            k = self.match[k] if k in self.match and self.match[k] > k else k
            k += 1
        return min(k, b)

    # -- statements ---------------------------------------------------------------------------------------------------------

    def _ends(self, k: int) -> bool:
        """Whether a statement may end after token k, at the end of its line."""
        x = self.t[k]
        return x.kind != "mark" or x.text in ")]}" or x.text in ("++", "--")

    def _goes_on(self, k: int) -> bool:
        """Whether token k, first of its line, goes on with the statement before it."""
        return self.t[k].kind == "mark" and self.t[k].text not in ("{", "!", "++", "--", "}", "(") and not self.go or self.is_(k, "else", ".", "?.", "catch", "finally")

    def statements(self, a: int, b: int) -> list[tuple[int, int]]:
        """Statements of tokens a to b - 1, as far as the bracket that closes the block they are in."""
        found, start, k = [], a, a
        while k < b:
            if self.match.get(k, a) < a:
                b = k
                break
            if self.is_(k, ";"):
                found.append((start, k))
                start = k + 1
            elif k > start and self.t[k].first and self._ends(k - 1) and not self._goes_on(k):
                found.append((start, k))
                start = k
            if k in self.match and self.match[k] > k:
                k = self.match[k]
            k += 1
        found.append((start, b))
        return [p for p in found if p[0] < p[1]]

    def salient(self, a: int, b: int) -> tuple[int, int] | None:
        """The statement that tells most: the first that returns (or throws), else the first."""
        given = self.statements(a, b)
        tells = ("return",) if self.go else ("return", "throw")
        return next((s for s in given if self.is_(s[0], *tells)), given[0] if given else None)

    # -- expressions --------------------------------------------------------------------------------------------------------

    def expression(self, a: int, b: int) -> dict | None:
        while self.is_(a, "(") and self.match.get(a) == b - 1:
            a, b = a + 1, b - 1
        for level in (["||"], ["&&"], COMPARE):
            at, k = -1, a
            while k < b:
                if k > a and self.is_(k, *level):
                    at = k
                k = self.match[k] if k in self.match and self.match[k] > k else k
                k += 1
            if at > 0:
                sides = [self.expression(a, at), self.expression(at + 1, b)]
                return None if None in sides else {"op": self.t[at].text, "args": sides}
        if a >= b:
            return None
        x = self.t[a]
        if self.is_(a, "!"):
            inner = self.expression(a + 1, b)
            return inner and {"op": "!", "args": [inner]}
        if self.is_(a, "-") and b - a == 2 and self.t[a + 1].kind == "number":
            return {"op": "lit", "text": "-" + self.t[a + 1].text}
        if b - a == 1 and (x.kind == "number" or x.kind == "string" and (self.go or x.text[0] != "`") or x.text in CONSTANTS[self.language]):
            return {"op": "lit", "text": " ".join(x.text.split())}
        path = all(self.t[k].kind == "word" if (k - a) % 2 == 0 else self.is_(k, ".") for k in range(a, b)) and (b - a) % 2 == 1
        return {"op": "path", "text": self.words(a, b).replace(" ", "")} if path and x.text != "undefined" else None

    # -- calls --------------------------------------------------------------------------------------------------------------

    def callee(self, k: int) -> int | None:
        """Where the callee of the call whose bracket is token k begins; None if it is no call."""
        at = k - 1
        if at < 0 or self.t[at].kind != "word" or self.t[at].text in NO_CALL:
            return None
        while self.is_(at - 1, ".", "?."):
            at -= 2
            while at >= 0 and self.is_(at, ")", "]") and at in self.match:
                at = self.match[at] - 1
                if not (at >= 0 and (self.t[at].kind == "word" and self.t[at].text not in NO_CALL or self.is_(at, ")", "]"))):
                    at += 1
                    break
        return None if self.is_(at - 1, "new", "func", "function") or at < 0 else at

    def string_in(self, a: int, b: int) -> str:
        return next((x.text[1:-1] for x in self.t[a:b] if x.kind == "string" and (self.go and x.text[0] != "'" or not self.go and x.text[0] != "`")), "")

    def failure_thrown(self, a: int, b: int) -> tuple[str, str] | None:
        """Code and kind of a throw statement of tokens a to b - 1."""
        text = self.string_in(a, b)
        if text:
            return text, "constructed"
        if self.is_(a + 1, "new"):
            end = self.find(a + 2, b, "(")
            return (self.words(a + 2, end), "sentinel") if end > a + 2 else None
        return (self.t[a + 1].text, "propagated") if b - a == 2 and self.t[a + 1].kind == "word" else None

    def action(self, a: int, b: int) -> tuple[str | None, str | None]:
        """Operation and value of a statement: return, throw (or panic), invoke."""
        if self.is_(a, "return"):
            value = ", ".join(self.words(*p) for p in self.split(a + 1, b, ",")) if self.go else self.words(a + 1, b)
            return "return", value.removesuffix(";") or None
        if self.is_(a, "throw"):
            return "throw", (self.failure_thrown(a, b) or (None,))[0]
        if self.is_(b - 1, ")") and (k := self.match.get(b - 1)) and self.callee(k) == a:
            name = self.words(a, k)
            if self.go and name == "panic":
                return "throw", self.string_in(k, b) or None
            return "invoke", name
        return None, None

    # -- branches -----------------------------------------------------------------------------------------------------------

    def inner(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Bodies of functions inside tokens a to b - 1."""
        for k in range(a, b):
            if self.is_(k, "func", "function"):
                start = self.body(k, b)
                if start is not None:
                    yield start, self.match[start]
            elif self.is_(k, "=>") and not self.go:
                if self.is_(k + 1, "{") and k + 1 in self.match:
                    yield k + 1, self.match[k + 1]

    def body(self, k: int, b: int) -> int | None:
        """The bracket that opens the body of the function whose word is token k."""
        at = k + 1
        while at < b and not self.is_(at, "("):
            at += 1
        if at not in self.match:
            return None
        at = self.match[at] + 1
        if self.go and self.is_(k + 1, "(") and at < b and self.t[at].kind == "word" and self.is_(self.find(at, b, "(", "{"), "("):
            at = self.match.get(self.find(at, b, "("), b) + 1  # after a receiver the parameters follow
        while at < b:
            if self.is_(at, "{"):
                if self.is_(at - 1, "interface", "struct", ":", "|", "&", "<") and at in self.match:
                    at = self.match[at]
                else:
                    return at if at in self.match else None
            elif at in self.match and self.match[at] > at:
                at = self.match[at]
            elif self.is_(at, ";"):
                return None
            at += 1
        return None

    def clauses(self, a: int, b: int) -> list[dict]:
        hidden = list(self.inner(a, b))
        found: list[dict] = []

        def add(when: str, expr: dict | None, span: tuple[int, int] | None) -> None:
            s = self.salient(*span) if span else None
            then = self.words(*s).removesuffix(";") if s else ""
            if then:
                op, value = self.action(*s)
                found.append({"when": when, "then": then, "when_expr": json.dumps(expr, separators=(",", ":")) if expr else None, "then_op": op, "then_value": value})

        def block(k: int) -> tuple[tuple[int, int] | None, int]:
            """The statements of the block (or the single statement) at token k, and what comes after it."""
            if self.is_(k, "{") and k in self.match:
                return (k + 1, self.match[k]), self.match[k] + 1
            one = self.statements(k, b)
            return (one[0], one[0][1]) if one else (None, k)

        k = a
        while k < b:
            skip = next((end for start, end in hidden if start <= k < end), None)
            if skip is not None:
                k = skip + 1
                continue
            if self.is_(k, "if") and not self.is_(k - 1, "."):
                if self.go:
                    end = self.find(k + 1, b, "{")
                    parts = self.split(k + 1, end, ";")
                    cond = parts[-1] if parts else (k + 1, k + 1)
                else:
                    end = self.match.get(k + 1, k + 1) + 1
                    cond = (k + 2, end - 1)
                span, after = block(end)
                add(self.words(*cond), self.expression(*cond), span)
                if self.is_(after, ";") and self.is_(after + 1, "else"):
                    after += 1
                if self.is_(after, "else") and self.is_(after + 1, "{"):
                    add("else", None, block(after + 1)[0])
            elif self.is_(k, "switch") and not self.is_(k - 1, "."):
                start = self.find(k + 1, b, "{")
                if start in self.match:
                    self._cases(k, start, add)
            k += 1
        return found

    def _cases(self, k: int, start: int, add) -> None:
        end = self.match[start]
        given = self.split(k + 1, start, ";")
        subject = given[-1] if given else None
        if subject and not self.go and self.is_(subject[0], "(") and self.match.get(subject[0]) == subject[1] - 1:
            subject = subject[0] + 1, subject[1] - 1
        typed = None
        if self.go and subject and self.is_(subject[1] - 2, "type") and self.is_(subject[1] - 1, ")"):
            at = self.find(*subject, ":=")
            typed = self.words(at + 1 if at < subject[1] else subject[0], subject[1] - 4)
        marks, at = [], start + 1
        while at < end:
            if self.is_(at, "case", "default") and not self.is_(at - 1, "."):
                marks.append(at)
            at = self.match[at] if at in self.match and self.match[at] > at else at
            at += 1
        for m, to in zip(marks, [*marks[1:], end], strict=True):
            colon = self.find(m + 1, to, ":")
            body = colon + 1, to
            if self.is_(m, "default"):
                add("else", None, body)
                continue
            values = self.split(m + 1, colon, ",") if self.go else [(m + 1, colon)]
            if typed is not None:
                add(f"{typed} is {self.words(*values[0]) if values else '?'}", None, body)
                continue
            equal = "==" if self.go else "==="
            texts = [f"{self.words(*subject)} {equal} {self.words(*v)}" if subject else self.words(*v) for v in values]
            exprs = []
            for v in values:
                sides = [self.expression(*subject), self.expression(*v)] if subject else []
                exprs.append(self.expression(*v) if not subject else None if None in sides else {"op": equal, "args": sides})
            whole = None
            if exprs and None not in exprs:
                whole = exprs[0]
                for e in exprs[1:]:
                    whole = {"op": "||", "args": [whole, e]}
            # a body may be statements on the line of its case
            add(" || ".join(texts), whole, body)

    # -- functions ----------------------------------------------------------------------------------------------------------

    def imports(self) -> dict[str, str]:
        """The path that each imported name comes from."""
        found: dict[str, str] = {}
        for k, x in enumerate(self.t):
            if not self.is_(k, "import") or self.is_(k - 1, "."):
                continue
            if self.go:
                span = (k + 2, self.match[k + 1]) if self.is_(k + 1, "(") and k + 1 in self.match else (k + 1, self.find_string(k + 1) + 1)
                for i in range(*span):
                    if self.t[i].kind == "string":
                        path, alias = self.t[i].text[1:-1], self.t[i - 1] if i - 1 >= span[0] and not self.t[i].first else None
                        if alias and alias.kind == "word":
                            found |= {} if alias.text == "_" else {alias.text: path}
                        elif not (alias and alias.text == "."):
                            parts = path.split("/")
                            name = parts[-2] if re.fullmatch(r"v\d+", parts[-1]) and len(parts) > 1 else parts[-1]
                            found[re.sub(r"\.v\d+$", "", name)] = path
            else:
                end = self.find_string(k + 1)
                if end >= len(self.t) or end - k > 400 or self.t[end].line - x.line > 200 or end == k + 1:
                    continue
                path = self.t[end].text[1:-1]
                names = [i for i in range(k + 1, end) if self.t[i].kind == "word" and self.t[i].text not in ("from", "as", "type")]
                found |= {self.t[i].text: path for i in names if not self.is_(i + 1, "as")}
        return found

    def find_string(self, k: int) -> int:
        while k < len(self.t) and self.t[k].kind != "string":
            k += 1
        return k

    def functions(self) -> Iterator[tuple[str, str | None, bool, tuple[int, int], tuple[int, int], tuple[int, int]]]:
        """Name, type of the receiver, whether it is public, and the tokens of parameters, result and body, of functions outside all others."""
        k = 0
        while k < len(self.t):
            if self.go and self.is_(k, "func") and self.t[k].first:
                at = self.match.get(k + 1, k) + 1 if self.is_(k + 1, "(") else k + 1
                if at < len(self.t) and self.t[at].kind == "word":
                    name, start = self.t[at].text, self.find(at + 1, len(self.t), "(", "[")
                    if self.is_(start, "["):
                        start = self.match.get(start, start) + 1
                    close = self.match.get(start, start)
                    body = self.body(at, len(self.t)) if start == at + 1 else self.body(start - 1, len(self.t))
                    if body is not None and close > start:
                        owner = next((self.t[i].text for i in range(k + 1, at) if self.t[i].kind == "word" and not self.is_(i - 1, "(", "[") or self.is_(i - 1, "(") and self.is_(i + 1, ")") and self.t[i].kind == "word"), None)
                        yield name, owner, name[:1].isupper(), (start + 1, close), (close + 1, body), (body + 1, self.match[body])
                        k = self.match[body]
            elif not self.go and self.t[k].first and not self.is_(k, "}"):
                public, at = self.is_(k, "export"), k
                while self.is_(at, "export", "default", "async", "declare"):
                    at += 1
                if self.is_(at, "function"):
                    at += 1 + self.is_(at + 1, "*")
                    start = self.find(at, len(self.t), "(", "{", ";")
                    body = self.body(at, len(self.t)) if self.is_(start, "(") else None
                    if body is not None and self.t[at].kind == "word":
                        yield self.t[at].text, None, public, (start + 1, self.match[start]), (self.match[start] + 1, body), (body + 1, self.match[body])
                        k = self.match[body]
                elif self.is_(at, "const", "let", "var"):
                    made = self._value(at + 1)
                    if made:
                        yield self.t[at + 1].text, None, public, *made
                        k = max(k, made[2][1] - 1)
            if k in self.match and self.match[k] > k:
                k = self.match[k]
            k += 1

    def _value(self, at: int) -> tuple | None:
        """Parameters, result and body of the function that a name at token `at` is set to."""
        n = len(self.t)
        if at >= n or self.t[at].kind != "word" or not self.is_(at + 1, "=", ":"):
            return None
        k = self.find(at + 1, min(n, at + 200), "=", ";") + 1
        if not self.is_(k - 1, "="):
            return None
        k += self.is_(k, "async")
        if self.is_(k, "function"):
            start, body = self.find(k, n, "("), self.body(k, n)
            return None if body is None or start not in self.match else ((start + 1, self.match[start]), (self.match[start] + 1, body), (body + 1, self.match[body]))
        if self.is_(k, "<"):
            k = self.find(k, n, "(")
        if self.is_(k, "(") and k in self.match:
            span, close = (k + 1, self.match[k]), self.match[k] + 1
        elif k < n and self.t[k].kind == "word" and self.is_(k + 1, "=>"):
            span, close = (k, k + 1), k + 1
        else:
            return None
        arrow = self.find(close, min(n, close + 200), "=>", ";", "=")
        if not self.is_(arrow, "=>"):
            return None
        if self.is_(arrow + 1, "{") and arrow + 1 in self.match:
            return span, (close, arrow), (arrow + 2, self.match[arrow + 1])
        rest = self.statements(arrow + 1, n)
        return span, (close, arrow), rest[0] if rest else (arrow + 1, arrow + 1)

    def inputs(self, a: int, b: int) -> list[dict]:
        parts = self.split(a, b, ",")
        if not self.go:
            return [self._input(p, i) for i, p in enumerate(parts)]
        named = any(self.t[p[0]].kind == "word" and p[1] - p[0] > 1 and not self.is_(p[0] + 1, ".") and not self.is_(p[0], "map", "chan", "func", "interface", "struct") for p in parts)
        if not named:  # types alone
            return [{"name": "_", "type": ("..." if self.is_(p[0], "...") else "") + self.words(p[0] + self.is_(p[0], "..."), p[1])} for p in parts]
        out, kind = [], ""
        for p in reversed(parts):  # names share the type that follows them
            if p[1] - p[0] > 1:
                kind = self.words(p[0] + 1, p[1])
            out.append({"name": self.t[p[0]].text, "type": kind or "unknown"})
        out.reverse()
        # variadic ones come last
        return [x for x in out if not x["type"].startswith("...")] + [x for x in out if x["type"].startswith("...")]

    def _input(self, p: tuple[int, int], place: int) -> dict:
        default = self.find(*p, "=")
        colon = self.find(p[0], default, ":")
        start = p[0]
        while start < colon and self.is_(start, "public", "private", "protected", "readonly", "..."):
            start += 1
        name = self.words(start, colon - self.is_(colon - 1, "?"))
        return {"name": name or f"arg{place + 1}", "type": self.words(colon + 1, default) if colon < default else "unknown"}

    def result(self, a: int, b: int) -> dict:
        a += not self.go and self.is_(a, ":")
        text = self.words(a, b)
        return {"type": text, "explicit": text != ""}

    def effects(self, a: int, b: int, imports: dict[str, str]) -> list[dict]:
        roots, calls = PURE[self.language]
        found: dict[str, dict] = {}
        for k in range(a, b):
            if not self.is_(k, "(") or (at := self.callee(k)) is None or at < a:
                continue
            full, method = self.text[self.t[at].start : self.t[k - 1].end], self.t[k - 1].text
            plain = all(self.t[i].kind == "word" or self.is_(i, ".", "?.") for i in range(at, k))
            root = self.t[at].text if plain and k - at > 1 else ""
            if root in roots or full in calls or full in found or not (root in imports or is_verb(method)):
                continue
            kind, basis = call_effect(method, root, imports.get(root))
            found[full] = {"name": full, "kind": kind, "basis": basis}
        return [found[x] for x in sorted(found)]

    def failures(self, a: int, b: int, result: str) -> list[dict]:
        found: dict[str, str] = {}
        for k in range(a, b):
            if not self.go and self.is_(k, "throw") and not self.is_(k - 1, "."):
                found |= dict([x] if (x := self.failure_thrown(*self.statements(k, b)[0])) else [])
            elif self.go and self.is_(k, "panic") and self.is_(k + 1, "(") and k + 1 in self.match and not self.is_(k - 1, "."):
                text = self.string_in(k + 1, self.match[k + 1])
                found |= {text: "constructed"} if text else {}
        if self.go and re.search(r"(?:^|[ (,])error\)?$|[ (,]error,", result):
            hidden = list(self.inner(a, b))
            for k in range(a, b):
                if self.is_(k, "return") and not any(x <= k < y for x, y in hidden):
                    found |= dict([x] if (x := self._returned(*self.statements(k, b)[0])) else [])
        return [{"code": c, "kind": found[c]} for c in sorted(found)]

    def _returned(self, a: int, b: int) -> tuple[str, str] | None:
        """The failure that the last operand of a return stands for; nil is none."""
        parts = self.split(a + 1, b, ",")
        if not parts:
            return None
        x, y = parts[-1]
        name = self.words(x, y)
        if self.is_(y - 1, ")"):
            k = self.match.get(y - 1, y)
            text = self.string_in(k, y) if self.words(x, k) in ("errors.New", "fmt.Errorf") else ""
            return (text, "constructed") if text else None
        last = self.t[y - 1].text
        if y - x == 1 and self.t[x].kind == "word":
            return None if name == "nil" else (name, "sentinel" if SENTINEL.match(name) else "propagated")
        return (last, "sentinel") if self.is_(y - 2, ".") and SENTINEL.match(last) else None


def intents(path: str, text: str, language: str) -> list[dict]:
    """What each function takes, returns, decides, fails with and calls for its effect."""
    try:
        return _intents(path, Source(text, language))
    except (IndexError, KeyError, RecursionError):  # brackets that don't match: no function can be told
        return []


def _intents(path: str, s: Source) -> list[dict]:
    imports, rows, language = s.imports(), [], s.language
    for name, owner, public, params, result, body in s.functions():
        returns = s.result(*result)
        rows.append({"rel_path": path, "name": name, "owner": owner, "language": language, "visibility": "public" if public else "private", "inputs": s.inputs(*params), "returns": returns, "behavior": s.clauses(*body), "effects": s.effects(*body, imports), "failures": s.failures(*body, returns["type"])})
    return rows
