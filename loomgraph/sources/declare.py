"""Declarations of Go and TypeScript files, from their tokens, scope by scope.

A file's own scope is read declaration by declaration: grouped ones, generic ones, and those over several lines. Inside a class the
members are read, of which those with a body are methods. What is inside functions, or inside brackets of any other kind, declares
nothing. A file whose brackets do not match gives what was read before the first that has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

from .braces import Source

#: Words before a member's name, unless they are the name.
MODIFIERS = ["public", "private", "protected", "static", "async", "readonly", "override", "abstract", "accessor", "get", "set", "declare"]


class Scopes(Source):
    """Declarations as (kind, receiver, label, exported, base, first token, token after the last)."""

    def declarations(self) -> Iterator[tuple]:
        yield from self._go() if self.go else self._script()

    def angles(self, k: int, b: int) -> int:
        """What comes after the type parameters that begin at token k, if any do."""
        if not self.is_(k, "<"):
            return k
        depth = 0
        while k < b:
            depth += self.is_(k, "<") - self.is_(k, ">")
            k = self.match[k] + 1 if self.match.get(k, -1) > k else k + 1
            if depth == 0:
                return k
        return b

    def past(self, k: int, b: int) -> int:
        """The token at which the statement after the one at token k begins."""
        start = k
        while k < b:
            if self.is_(k, ";"):
                return k + 1
            if k > start and self.t[k].first and self._ends(k - 1) and (self.is_(k, "@") or not self._goes_on(k)):
                return k
            k = self.match[k] + 1 if self.match.get(k, -1) > k else k + 1
        return b

    # -- Go -----------------------------------------------------------------------------------------------------------------

    def _go(self) -> Iterator[tuple]:
        k, n = 0, len(self.t)
        while k < n:
            end = self.past(k, n)
            if self.is_(k, "package") and k + 1 < n:
                yield "package", "", self.t[k + 1].text, None, "", k, end
            elif self.is_(k, "import"):
                span = (k + 2, self.match[k + 1]) if self.is_(k + 1, "(") and k + 1 in self.match else (k + 1, end)
                yield from (("import", "", self.t[i].text[1:-1], None, "", i, i + 1) for i in range(*span) if self.t[i].kind == "string" and len(self.t[i].text) > 2)
            elif self.is_(k, "func"):
                yield from self._func(k, end)
            elif self.is_(k, "type"):
                if self.is_(k + 1, "(") and k + 1 in self.match:
                    at, close = k + 2, self.match[k + 1]
                    while at < close:
                        after = self.past(at, close)
                        yield from self._type(at, after)
                        at = after
                else:
                    yield from self._type(k + 1, end, k)
            k = max(end, k + 1)

    def _func(self, k: int, end: int) -> Iterator[tuple]:
        at, receiver = k + 1, ""
        if self.is_(at, "(") and at in self.match:
            close = self.match[at]
            # the type of the receiver comes last, before its own parameters
            words = [self.t[i].text for i in range(at + 1, self.find(at + 1, close, "[")) if self.t[i].kind == "word"]
            receiver, at = words[-1] if words else "", close + 1
        if at < end and self.t[at].kind == "word" and self.is_(at + 1, "(", "["):
            name = self.t[at].text
            yield "method" if receiver or at > k + 1 else "function", receiver, name, name[:1].isupper(), "", k, end

    def _type(self, at: int, end: int, first: int | None = None) -> Iterator[tuple]:
        if at >= end or self.t[at].kind != "word":
            return
        k = at + 1
        # `[T any]` are parameters, `[N]int` and `[]int` are types
        if self.is_(k, "[") and self.match.get(k, k) > k + 2 and self.t[k + 1].kind == "word" and (self.t[k + 2].kind == "word" or self.is_(k + 2, ",", "~", "interface")):
            k = self.match[k] + 1
        kind = "struct" if self.is_(k, "struct") else "interface" if self.is_(k, "interface") else "alias"
        if k < end:
            yield kind, "", self.t[at].text, self.t[at].text[:1].isupper(), "", at if first is None else first, end

    # -- TypeScript ---------------------------------------------------------------------------------------------------------

    def _script(self) -> Iterator[tuple]:
        k, n = 0, len(self.t)
        while k < n:
            start, at = k, self._decorated(k, n)
            public = self.is_(at, "export")
            at += public
            at += public and self.is_(at, "default")
            end = self.past(k, n)
            if self.is_(at, "import") and not self.is_(at + 1, "(", "."):
                i = next((i for i in range(at + 1, end) if self.t[i].kind == "string"), end)
                if i < end and len(self.t[i].text) > 2:
                    yield "import", "", self.t[i].text[1:-1], None, "", start, end
            elif self.is_(at, "function") or self.is_(at, "async") and self.is_(at + 1, "function"):
                name = at + 1 + self.is_(at, "async")
                name += self.is_(name, "*")
                body = self._body(name + 1, n) if name < n and self.t[name].kind == "word" else None
                if body is not None:
                    end = self.match[body] + 1
                    yield "function", "", self.t[name].text, public, "", start, end
            elif self.is_(at, "class") or self.is_(at, "abstract") and self.is_(at + 1, "class"):
                end = yield from self._class(at + 1 + self.is_(at, "abstract"), n, public, start, end)
            elif self.is_(at, "interface", "enum", "type") or self.is_(at, "const") and self.is_(at + 1, "enum"):
                kind = at + self.is_(at, "const")
                if kind + 1 < n and self.t[kind + 1].kind == "word" and not self.is_(kind + 1, "of", "in", "instanceof"):
                    end = self._closed(kind + 2, n, end) if not self.is_(kind, "type") else end
                    yield self.t[kind].text, "", self.t[kind + 1].text, public, "", start, end
            elif self.is_(at, "const", "let", "var"):
                yield from (("function", "", self.t[a].text, public, "", start, end) for a, b in self._declarators(at + 1, end) if self._is_function(a, b))
            k = max(end, k + 1)

    def _decorated(self, k: int, b: int) -> int:
        """What comes after the decorators at token k."""
        while self.is_(k, "@") and k + 1 < b:
            k += 2
            while self.is_(k, "."):
                k += 2
            if self.is_(k, "(") and k in self.match:
                k = self.match[k] + 1
        return k

    def _closed(self, k: int, b: int, end: int) -> int:
        """What comes after the first block from token k on."""
        while k < b and not self.is_(k, "{", ";"):
            k = self.angles(k, b) if self.is_(k, "<") else k + 1
        return self.match[k] + 1 if self.is_(k, "{") and k in self.match else end

    def _body(self, k: int, b: int) -> int | None:
        """The bracket that opens the body of the function whose parameters (of types, then of values) begin at token k."""
        k = self.angles(k, b)
        if not self.is_(k, "(") or k not in self.match:
            return None
        k = self.match[k] + 1
        if not self.is_(k, ":"):
            return k if self.is_(k, "{") and k in self.match else None
        k += 1
        operand = True  # whether a type is still to come, so that a brace begins one
        while k < b:
            if self.is_(k, "{"):
                if not operand:
                    return k if k in self.match else None
                k, operand = self.match.get(k, b) + 1, False
            elif self.is_(k, "<"):
                k = self.angles(k, b)
            elif self.is_(k, ";", "}") or not operand and self.t[k].first and not self.is_(k, "|", "&", ".", "=>", "["):
                return None
            else:
                operand = self.is_(k, "|", "&", "=>", "keyof", "typeof", "is", "extends", "?", ":", ".", "readonly", "asserts", "infer", "unique")
                k = self.match[k] + 1 if self.match.get(k, -1) > k else k + 1
        return None

    def _class(self, at: int, n: int, public: bool, start: int, end: int):
        if at >= n or self.t[at].kind != "word" or self.is_(at, "extends", "implements"):
            return end
        name, base, k = self.t[at].text, "", self.angles(at + 1, n)
        while k < n and not self.is_(k, "{"):
            if self.is_(k, "extends") and k + 1 < n and self.t[k + 1].kind == "word":
                base, k = self.t[k + 1].text, k + 2
            elif self.is_(k, "<"):
                k = self.angles(k, n)
            else:
                k = self.match[k] + 1 if self.match.get(k, -1) > k else k + 1
        if k not in self.match:
            return end
        yield "class", "", name, public, base, start, self.match[k] + 1
        yield from self._members(name, public, k + 1, self.match[k])
        return self.match[k] + 1

    def _members(self, owner: str, public: bool, k: int, b: int) -> Iterator[tuple]:
        while k < b:
            start = k
            k = self._decorated(k, b)
            hidden = False
            while self.is_(k, *MODIFIERS) and not self.is_(k + 1, "(", "<", "=", ":", ";", "?", "!", "}"):
                hidden |= self.is_(k, "private", "protected")
                k += 1
            k += self.is_(k, "*")
            if k >= b:
                return
            computed = self.is_(k, "[") and k in self.match
            name = self.words(k, self.match[k] + 1) if computed else self.t[k].text
            after = (self.match[k] if computed else k) + 1
            after += self.is_(after, "?", "!")
            body = self._body(after, b) if computed or self.t[k].kind in ("word", "string", "number") else None
            end = self.match[body] + 1 if body is not None else max(self.past(start, b), start + 1)
            if body is not None:
                yield "method", owner, name, public and not hidden and not name.startswith("#"), "", start, end
            k = end

    def _declarators(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The declarators of tokens a to b - 1; a comma among type parameters is none between them."""
        while a < b:
            k = self.find(a, b, "=", ",")
            if self.is_(k, "="):
                k += 1 + self.is_(k + 1, "async")
                k = self.find(self.angles(k, b), b, ",")
            yield a, k
            a = k + 1

    def _is_function(self, a: int, b: int) -> bool:
        """Whether the declarator of tokens a to b - 1 sets a name to a function."""
        if self.t[a].kind != "word":
            return False
        k = self.find(a + 1, b, "=") + 1
        k += self.is_(k, "async") and not self.is_(k + 1, "=>")
        if k >= b or self.is_(k, "function"):
            return k < b
        k = self.angles(k, b)
        if self.is_(k, "(") and k in self.match:
            close = self.match[k] + 1
            return self.is_(close, "=>") or self.is_(close, ":") and self.is_(self.find(close, b, "=>", "?"), "=>")
        return k < b and self.t[k].kind == "word" and self.is_(k + 1, "=>")


def declarations(path: str, text: str, language: str) -> list[dict]:
    """What a file declares, in order."""
    s, rows = Scopes(text, language), []
    try:
        for kind, receiver, label, public, base, first, after in s.declarations():
            last = s.t[min(after, len(s.t)) - 1]
            rows.append({"rel_path": path, "kind": kind, "receiver": receiver, "label": label, "exported": bool(public), "base": base, "line_start": s.t[first].line, "line_end": last.line + last.text.count("\n")})
    except (IndexError, KeyError, RecursionError):  # brackets that don't match
        pass
    return rows
