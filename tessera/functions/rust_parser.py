"""Items, calls and type references of Rust source, by recursive descent over tokens.

The parser doesn't build a tree: it reports what the code graph needs, with the stack of
enclosing items. It never fails; on text it doesn't understand it skips a token.
"""

from __future__ import annotations

import bisect
import sys
from dataclasses import dataclass, field

from .rust_lexer import Token, tokenize

# Primitive types, which are no type references.
PRIMITIVES = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
# Words that are no identifiers inside a macro's tokens.
KEYWORDS = frozenset(
    "as async await break const continue default enum fn for gen if impl let loop match mod pub return static struct trait type union unsafe use where while mut self super crate true false".split()
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_ITEM_START = frozenset("fn struct enum union trait impl type const static mod use extern macro_rules pub unsafe async default".split())


@dataclass
class Facts:
    """What a file says: nodes (start, type, payload), edges by item and name, use paths."""

    nodes: list[tuple[str, str, str | None]] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    use_paths: list[str] = field(default_factory=list)


@dataclass
class _Attribute:
    start: int
    end: int
    outside: frozenset[str]
    anywhere: frozenset[str]

    def names(self, name: str) -> bool:
        """Inside brackets only ``test`` counts: cfg(test) marks a test, cfg(bench) no benchmark."""
        return name in (self.anywhere if name == "test" else self.outside)


class Parser:
    def __init__(self, file_id: str, text: str) -> None:
        self.file_id, self.text = file_id, text
        self.tokens = tokenize(text)
        self.at = 0
        self.facts = Facts([(file_id, "file", None)])
        self.stack = [file_id]
        self.attributes: list[_Attribute] = []
        self.lines = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    # Tokens

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].kind if i < len(self.tokens) else ""

    def next(self) -> Token:
        t = self.tokens[self.at]
        self.at += 1
        return t

    def more(self) -> bool:
        return self.at < len(self.tokens)

    def seq(self, text: str, ahead: int = 0) -> bool:
        """Whether the punctuation ``text`` stands next, its characters adjacent."""
        i = self.at + ahead
        ts = self.tokens[i : i + len(text)]
        return len(ts) == len(text) and all(t.text == c and t.kind == "punct" for t, c in zip(ts, text, strict=True)) and ts[-1].end - ts[0].start == len(text)

    def take(self, text: str) -> bool:
        if self.kind() in ("punct", "ident") and self.peek() == text:
            self.at += 1
            return True
        return False

    def ident(self, ahead: int = 0) -> bool:
        return self.kind(ahead) == "ident"

    def plain(self, ahead: int = 0) -> bool:
        """An identifier that is no keyword, or one that may begin a path."""
        return self.ident(ahead) and (self.peek(ahead) not in KEYWORDS or self.peek(ahead) in ("self", "super", "crate", "default", "union", "gen"))

    def skip_tree(self) -> None:
        """Skip a bracketed group, or one token."""
        depth = 0
        while self.more():
            t = self.next()
            if t.kind == "punct":
                depth += (t.text in _OPEN) - (t.text in _CLOSE)
            if depth <= 0:
                return

    # Reports

    def position(self, offset: int) -> str:
        row = bisect.bisect_right(self.lines, offset) - 1
        column = len(self.text[self.lines[row] : offset].encode("utf-8", "surrogatepass"))
        return f"{self.file_id}#{row + 1}:{column + 1}"

    def edge(self, name: str, kind: str) -> None:
        self.facts.edges.append((self.stack[-1], f"{self.file_id}::{name}", kind))

    def refer(self, name: str) -> None:
        if name not in PRIMITIVES:
            self.edge(name, "references")

    def enter(self, start: int, kind: str, payload: str | None) -> None:
        node = self.position(start)
        self.facts.nodes.append((node, kind, payload))
        self.facts.edges.append((self.stack[-1], node, "contains"))
        self.stack.append(node)

    # Attributes and visibility

    def attribute(self) -> None:
        """``#[...]`` is kept; ``#![...]`` belongs to what encloses it and is skipped."""
        start, inner = self.next().start, self.take("!")
        if self.peek() != "[":
            return
        first = self.at
        self.skip_tree()
        if inner:
            return
        outside, anywhere, depth = set(), set(), 0
        for t in self.tokens[first + 1 : self.at - 1]:
            if t.kind == "punct":
                depth += (t.text in _OPEN) - (t.text in _CLOSE)
            elif t.kind == "ident":
                anywhere.add(t.text)
                if not depth:
                    outside.add(t.text)
        self.attributes.append(_Attribute(start, self.tokens[self.at - 1].end, frozenset(outside), frozenset(anywhere)))

    def marked(self, name: str, start: int, first: int) -> bool:
        """An attribute before ``start`` with nothing but white space between, or one inside the item."""
        if any(a.names(name) for a in self.attributes[first:]):
            return True
        for a in reversed(self.attributes[:first]):
            if self.text[a.end : start].strip():
                return False
            if a.names(name):
                return True
            start = a.start
        return False

    def visibility(self) -> bool:
        if self.peek() == "crate" and not self.seq("::", 1) and self.ident(1):
            self.at += 1
            return True
        if self.peek() != "pub":
            return False
        self.at += 1
        if self.peek() == "(" and self.peek(1) in ("crate", "self", "super", "in"):
            self.skip_tree()
        return True

    # Items

    def items(self, close: str = "") -> None:
        while self.more() and not (close and self.peek() == close and self.kind() == "punct"):
            before = self.at
            if not self.item():
                if self.at == before:
                    self.skip_tree()
        if close:
            self.take(close)

    def item(self) -> bool:
        """One item, attribute or macro in item position; False if none stands here."""
        if self.peek() == "#" and self.kind() == "punct":
            self.attribute()
            return True
        if self.take(";"):
            return True
        start_at = self.at
        start = self.tokens[self.at].start
        public = self.visibility()
        modifiers = set()
        while self.peek() in ("default", "async", "unsafe", "const", "extern", "safe", "gen") and self.ident():
            word, ahead = self.peek(), self.peek(1)
            if word == "const" and ahead not in ("fn", "unsafe", "async", "extern"):
                break
            if word == "extern" and (ahead in ("crate", "{") or (self.kind(1) == "literal" and self.peek(2) == "{")):
                break
            if word == "unsafe" and ahead == "{" or word in ("default", "safe", "gen") and self.kind(1) != "ident" or word == "async" and ahead not in ("fn", "unsafe", "extern"):
                break
            modifiers.add(self.next().text)
            if word == "extern" and self.kind() == "literal":
                self.at += 1
        word = self.peek() if self.ident() else ""
        handler = {"fn": self.function, "struct": self.record, "union": self.record, "enum": self.enum, "trait": self.trait, "impl": self.implementation, "type": self.alias, "const": self.constant, "static": self.constant, "mod": self.module, "use": self.use, "extern": self.foreign}.get(word)
        if word == "union" and not (self.ident(1) and self.peek(2) in ("{", "<", "where")):
            handler = None
        if word == "auto" and self.peek(1) == "trait":
            self.at += 1
            handler = self.trait
        if handler is None:
            if word == "macro_rules" and self.peek(1) == "!":
                self.macro_rules(start)
                return True
            if self.plain() and self.path_then_bang():
                self.macro_call()
                self.take(";")
                return True
            self.at = start_at
            return False
        handler(start, public, modifiers)
        return True

    def function(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        name = self.next().text if self.ident() else None
        # A signature without a body is no node; find out before reporting what it holds.
        mark, save = self.at, (len(self.facts.nodes), len(self.facts.edges), len(self.attributes))
        first = len(self.attributes)
        self.enter(start, "function", None)
        here = len(self.facts.nodes) - 1
        if "unsafe" in modifiers:
            self.facts.edges.append((self.stack[-1], self.stack[-1], "uses_unsafe"))
        self.signature()
        if self.peek() == "{":
            self.block()
            prefix = "pub::" if public else ""
            prefix += "test::" if self.marked("test", start, first) else "bench::" if self.marked("bench", start, first) else ""
            self.facts.nodes[here] = (self.stack.pop(), "function", name and prefix + name)
            return
        self.take(";")
        end = self.at
        self.stack.pop()
        del self.facts.nodes[save[0] :], self.facts.edges[save[1] :], self.attributes[save[2] :]
        self.at = mark
        self.signature()
        self.at = max(self.at, end)

    def signature(self) -> None:
        self.generics()
        if self.peek() == "(":
            self.at += 1
            while self.more() and self.peek() != ")":
                before = self.at
                if self.peek() == "#":
                    self.attribute()
                    continue
                self.pattern({":", ",", ")"})
                if self.take(":"):
                    if self.seq("..."):
                        self.at += 3
                    else:
                        self.type()
                self.take(",")
                if self.at == before:
                    self.skip_tree()
            self.take(")")
        if self.seq("->"):
            self.at += 2
            self.type()
        self.where()

    def record(self, start: int, public: bool, modifiers: set[str]) -> None:
        """struct, or union, which is no node."""
        node = self.next().text == "struct"
        name = self.next().text if self.ident() else None
        if node:
            self.enter(start, "struct", name)
        if name:
            self.refer(name)
        self.generics()
        self.where()
        self.fields()
        self.where()
        self.take(";")
        if node:
            self.stack.pop()

    def fields(self) -> None:
        """Named or positional fields of a struct or variant."""
        if self.peek() not in ("{", "("):
            return
        close, named = _OPEN[self.peek()], self.peek() == "{"
        self.at += 1
        while self.more() and self.peek() != close:
            before = self.at
            if self.peek() == "#":
                self.attribute()
                continue
            self.visibility()
            if named and self.ident() and self.peek(1) == ":":
                self.at += 2
            self.type()
            if self.take("="):
                self.expression({",", close})
            self.take(",")
            if self.at == before:
                self.skip_tree()
        self.take(close)

    def enum(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        name = self.next().text if self.ident() else None
        self.enter(start, "enum", name)
        if name:
            self.refer(name)
        self.generics()
        self.where()
        if self.take("{"):
            while self.more() and self.peek() != "}":
                before = self.at
                if self.peek() == "#":
                    self.attribute()
                    continue
                self.visibility()
                if self.ident():
                    self.at += 1
                self.fields()
                if self.take("="):
                    self.expression({",", "}"})
                self.take(",")
                if self.at == before:
                    self.skip_tree()
            self.take("}")
        self.stack.pop()

    def trait(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        name = self.next().text if self.ident() else None
        self.enter(start, "trait", name)
        if name:
            self.refer(name)
        self.generics()
        if self.take(":"):
            self.bounds()
        self.where()
        if self.take("{"):
            self.items("}")
        self.take(";")
        self.stack.pop()

    def implementation(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        # Children of the impl that name a type decide its payload and its trait.
        self.enter(start, "impl", None)
        here = len(self.facts.nodes) - 1
        if "unsafe" in modifiers:
            self.facts.edges.append((self.stack[-1], self.stack[-1], "uses_unsafe"))
        if self.peek() == "<":
            self.generics()
        self.take("const")
        self.take("!")
        first = self.head_type()
        second = self.head_type() if self.take("for") else None
        payload = next((x[1] for x in (first, second) if x and x[0] == "plain"), None)
        if second and first and first[0] != "other":
            self.edge(first[1], "implements_trait")
        self.where()
        if self.take("{"):
            self.items("}")
        self.facts.nodes[here] = (self.stack.pop(), "impl", payload)

    def head_type(self) -> tuple[str, str]:
        """Parse a type; (plain, name), (scoped, last segment) or (other, '')."""
        first = self.at
        self.type()
        ts = self.tokens[first : self.at]
        if len(ts) == 1 and ts[0].kind == "ident" and ts[0].text not in PRIMITIVES:
            return "plain", ts[0].text
        if ts and ts[-1].kind == "ident" and len(ts) > 2 and ts[-2].text == ":" and (ts[0].kind == "ident" or ts[0].text == ":") and ts[0].text not in ("dyn", "impl"):
            return "scoped", ts[-1].text
        return "other", ""

    def alias(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        name = self.next().text if self.ident() else None
        look, depth = self.at, 0
        while look < len(self.tokens):  # without a value it is an associated type, no node
            t = self.tokens[look].text
            depth += (t in "<([{") - (t in ">)]}") if self.tokens[look].kind == "punct" else 0
            if not depth and t in (";", "=") or depth < 0:
                break
            look += 1
        node = look < len(self.tokens) and self.tokens[look].text == "="
        if node:
            self.enter(start, "type_alias", name)
        if name:
            self.refer(name)
        self.generics()
        if self.take(":"):
            self.bounds()
        self.where()
        if self.take("="):
            self.type()
        self.where()
        self.take(";")
        if node:
            self.stack.pop()

    def constant(self, start: int, public: bool, modifiers: set[str]) -> None:
        kind = self.next().text
        self.take("mut")
        name = self.next().text if self.ident() else None
        self.enter(start, kind, name)
        self.generics()
        if self.take(":"):
            self.type()
        if self.take("="):
            self.expression({";"})
        self.take(";")
        self.stack.pop()

    def module(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        name = self.next().text if self.ident() else None
        self.enter(start, "module", name)
        if self.take("{"):
            self.items("}")
        else:
            self.take(";")
        self.stack.pop()

    def use(self, start: int, public: bool, modifiers: set[str]) -> None:
        while self.more() and self.peek() != ";":
            self.skip_tree()
        end = self.tokens[self.at].end if self.more() else len(self.text)
        self.take(";")
        path = self.text[start:end].removeprefix("use ").rstrip(";").strip()
        if path:
            self.facts.use_paths.append(path)

    def foreign(self, start: int, public: bool, modifiers: set[str]) -> None:
        self.at += 1
        if self.take("crate"):
            while self.more() and not self.take(";"):
                self.at += 1
            return
        if self.kind() == "literal":
            self.at += 1
        if self.take("{"):
            self.items("}")

    def macro_rules(self, start: int) -> None:
        self.at += 2
        name = self.next().text if self.ident() else None
        self.enter(start, "macro", name)
        self.stack.pop()
        self.skip_tree()
        self.take(";")

    # Macros

    def path_then_bang(self) -> bool:
        i = 0
        while self.ident(i) and self.seq("::", i + 1):
            i += 3
        return self.ident(i) and self.peek(i + 1) == "!" and not self.seq("!=", i + 1) and self.peek(i + 2) in ("(", "[", "{")

    def macro_call(self) -> None:
        """``path!(...)``: expands_to, and calls if the tokens are in parentheses."""
        while self.seq("::", 1):
            self.at += 3
        self.edge(self.next().text, "expands_to")
        self.at += 1
        first, paren = self.at, self.peek() == "("
        self.skip_tree()
        if paren:
            self.calls_in(first, self.at)

    def calls_in(self, lo: int, hi: int) -> None:
        """Identifiers before a parenthesis among raw tokens, unless a dot precedes."""
        ts = self.tokens
        for i in range(lo, hi - 1):
            t = ts[i]
            if t.kind == "ident" and t.text not in KEYWORDS and t.text not in PRIMITIVES and ts[i + 1].text == "(" and ts[i + 1].kind == "punct" and ts[i - 1].text not in (".", "$"):
                self.edge(t.text, "calls")

    # Types

    def generics(self) -> None:
        if self.peek() != "<":
            return
        self.at += 1
        while self.more() and self.peek() != ">":
            before = self.at
            if self.peek() == "#":
                self.attribute()
                continue
            if self.kind() == "lifetime":
                self.at += 1
                if self.take(":"):
                    self.bounds()
            elif self.take("const"):
                self.at += 1
                if self.take(":"):
                    self.type()
                if self.take("="):
                    self.const_argument()
            elif self.ident():
                self.refer(self.next().text)
                if self.take(":"):
                    self.bounds()
                if self.take("="):
                    self.type()
            self.take(",")
            if self.at == before:
                self.skip_tree()
        self.take(">")

    def const_argument(self) -> None:
        if self.peek() == "{":
            self.block()
        else:
            self.take("-")
            if self.more() and self.peek() not in (">", ","):
                self.at += 1

    def where(self) -> None:
        if not self.take("where"):
            return
        while self.more() and self.peek() not in ("{", ";", "=", "("):
            before = self.at
            if self.kind() == "lifetime":
                self.at += 1
            else:
                self.type()
            if self.take(":"):
                self.bounds()
            if not self.take(",") and self.at == before:
                self.skip_tree()

    def bounds(self) -> None:
        while self.more():
            if self.kind() == "lifetime":
                self.at += 1
            elif self.peek() == "?" or self.peek() == "~":
                self.at += 1
                continue
            elif self.peek() in ("const", "async") and self.ident():
                self.at += 1
                continue
            elif self.peek() == "(":
                self.at += 1
                self.bounds()
                self.take(")")
            elif self.ident() or self.peek() in ("<", ":", "&"):
                before = self.at
                self.one_type()
                if self.at == before:
                    return
            if not self.take("+"):
                return

    def type(self) -> None:
        self.one_type()
        while self.peek() == "+" and not self.seq("+="):
            self.at += 1
            self.bounds()

    def one_type(self) -> None:
        if not self.more():
            return
        t, kind = self.peek(), self.kind()
        if kind == "lifetime":
            self.at += 1
        elif kind == "punct":
            if t == "&":
                self.at += 1
                if self.kind() == "lifetime":
                    self.at += 1
                self.take("mut")
                self.one_type()
            elif t == "*":
                self.at += 1
                if self.peek() in ("const", "mut"):
                    self.at += 1
                self.one_type()
            elif t == "!":
                self.at += 1
            elif t == "?":
                self.at += 1
                self.one_type()
            elif t == "(":
                self.at += 1
                while self.more() and self.peek() != ")":
                    before = self.at
                    self.type()
                    self.take(",")
                    if self.at == before:
                        self.skip_tree()
                self.take(")")
            elif t == "[":
                self.at += 1
                self.type()
                if self.take(";"):
                    self.expression({"]"})
                self.take("]")
            elif t == "<" or self.seq("::"):
                self.type_path()
        elif kind == "ident":
            if t in ("dyn", "impl") and (self.ident(1) or self.kind(1) == "lifetime" or self.peek(1) in ("(", "?", "<", ":")):
                self.at += 1
                self.bounds()
            elif t == "mut":
                self.at += 1
                self.one_type()
            elif t == "for" and self.peek(1) == "<":
                self.at += 1
                self.generics()
                self.one_type()
            elif t in ("unsafe", "extern", "fn"):
                while self.peek() in ("unsafe", "extern") or self.kind() == "literal":
                    self.at += 1
                if self.take("fn"):
                    self.function_type()
            elif self.plain() or t == "Self":
                if self.path_then_bang():
                    self.macro_call()
                else:
                    self.type_path()

    def function_type(self) -> None:
        if self.take("("):
            while self.more() and self.peek() != ")":
                before = self.at
                if self.peek() == "#":
                    self.attribute()
                    continue
                if self.ident() and self.peek(1) == ":" and not self.seq("::", 1):
                    self.at += 2
                if self.seq("..."):
                    self.at += 3
                else:
                    self.type()
                self.take(",")
                if self.at == before:
                    self.skip_tree()
            self.take(")")
        if self.seq("->"):
            self.at += 2
            self.one_type()

    def type_path(self) -> None:
        """Names that are types: the last segment, and any segment with arguments."""
        if self.peek() == "<":
            self.at += 1
            self.type()
            if self.take("as"):
                self.type()
            self.take(">")
        last = None
        while self.more():
            if self.seq("::"):
                self.at += 2
                if self.peek() == "<":
                    self.arguments()
                    continue
            if not (self.plain() or self.peek() == "Self"):
                break
            last = self.next().text
            if self.peek() == "<" and not self.seq("<=") or self.seq("::") and self.peek(2) == "<":
                self.at += 2 if self.peek() == ":" else 0
                self.refer(last)
                last = None
                self.arguments()
            elif self.peek() == "(":  # Fn(A) -> B
                self.refer(last)
                last = None
                self.function_type()
                break
            if not self.seq("::"):
                break
        if last is not None and last not in ("crate", "self", "super"):
            self.refer(last)

    def arguments(self) -> None:
        """``<...>`` after a path."""
        self.at += 1
        while self.more() and self.peek() != ">":
            before = self.at
            if self.kind() == "literal" or self.peek() in ("-", "{"):
                self.const_argument()
            elif self.ident() and (self.peek(1) == "=" or self.peek(1) == ":" and not self.seq("::", 1)):
                self.refer(self.next().text)
                if self.take("="):
                    self.const_argument() if self.kind() == "literal" or self.peek() == "{" else self.type()
                else:
                    self.at += 1
                    self.bounds()
            else:
                self.type()
                if self.take(":"):
                    self.bounds()
                elif self.take("="):
                    self.type()
            self.take(",")
            if self.at == before:
                if self.peek() in (")", "]", "}", ";"):
                    return
                self.skip_tree()
        self.take(">")

    # Patterns

    def pattern(self, stop: set[str]) -> None:
        """Up to one of ``stop`` outside brackets. Struct patterns name a type."""
        while self.more():
            t, kind = self.peek(), self.kind()
            if kind == "punct" and (t in stop and not (t == ":" and self.seq("::")) and not (t == "=" and (self.seq("==") or self.tokens[self.at - 1].text == "." and self.tokens[self.at - 1].end == self.tokens[self.at].start))):
                return
            if kind == "ident" and t in stop:
                return
            if kind == "punct" and t in _CLOSE:
                return
            if kind == "punct" and t in ("(", "["):
                self.at += 1
                self.pattern({_OPEN[t]})
                self.take(_OPEN[t])
            elif kind == "punct" and t == "{":
                if "{" in stop:
                    return
                self.skip_tree()
            elif t == "#" and kind == "punct":
                self.attribute()
            elif kind == "punct" and t == "<":
                self.path("pattern")
            elif kind == "ident" and (self.plain() or t == "Self"):
                if self.path_then_bang():
                    self.macro_call()
                else:
                    self.path("pattern")
            elif kind == "ident" and t == "const" and self.peek(1) == "{":
                self.at += 1
                self.block()
            else:
                self.at += 1

    def field_patterns(self) -> None:
        self.at += 1
        while self.more() and self.peek() != "}":
            before = self.at
            if self.peek() == "#":
                self.attribute()
                continue
            if self.ident() and self.peek(1) == ":" and not self.seq("::", 1):
                self.at += 2
            self.pattern({",", "}"})
            self.take(",")
            if self.at == before:
                self.skip_tree()
        self.take("}")

    # Expressions

    def block(self) -> None:
        """``{ ... }`` with items, let statements and expressions."""
        self.at += 1
        while self.more() and self.peek() != "}":
            before = self.at
            self.statement()
            if self.at == before:
                if self.peek() in _CLOSE:
                    break
                self.skip_tree()
        self.take("}")

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.peek() == "#" and self.kind() == "punct":
            self.attribute()
            return
        if self.ident() and self.peek() == "let":
            self.at += 1
            self.pattern({":", "=", ";"})
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression({";", "else"})
            if self.take("else") and self.peek() == "{":
                self.block()
            self.take(";")
            return
        starts = self.ident() and self.peek() in _ITEM_START
        closure = self.peek() in ("async", "unsafe", "const") and self.peek(1) in ("{", "move", "|")
        path_use = self.peek() in ("default", "union") and not self.ident(1)
        if starts and not closure and not path_use and self.item():
            return
        self.expression({";"}, statement=True)
        self.take(";")

    def path(self, where: str) -> None:
        """A path in an expression or pattern, with what follows: macro, call or struct body.

        where: expr, head (no struct body may follow) or pattern.
        """
        start, first = self.tokens[self.at].start, self.at
        generic_tail = False
        if self.peek() == "<":
            self.at += 1
            self.type()
            if self.take("as"):
                self.type()
            self.take(">")
        last, segments = "", 0
        while self.more():
            if self.seq("::"):
                self.at += 2
                if self.peek() == "<":
                    if last:
                        generic_tail = True
                    self.arguments()
                    continue
            if not (self.plain() or self.peek() == "Self"):
                break
            if generic_tail and last:  # a generic segment inside a path is a type
                self.refer(last)
            generic_tail = False
            last = self.next().text
            segments += 1
            if not self.seq("::"):
                break
        end = self.tokens[self.at - 1].end if self.at > first else start
        if where != "pattern" and self.peek() == "(" and not generic_tail and last and last not in ("self", "super", "crate"):
            self.edge(self.text[start:end], "calls")
        elif self.peek() == "{" and where != "head" and last and self.tokens[self.at - 1].kind in ("ident", "punct"):
            if last not in ("self", "super", "crate"):
                self.refer(last)
            self.field_patterns() if where == "pattern" else self.field_values()

    def field_values(self) -> None:
        self.at += 1
        while self.more() and self.peek() != "}":
            before = self.at
            if self.peek() == "#":
                self.attribute()
                continue
            if self.seq(".."):
                self.at += 2
            elif self.kind() in ("ident", "literal") and self.peek(1) == ":" and not self.seq("::", 1):
                self.at += 2
            self.expression({",", "}"})
            self.take(",")
            if self.at == before:
                self.skip_tree()
        self.take("}")

    def group(self) -> None:
        """Comma- or semicolon-separated expressions in ``(...)`` or ``[...]``."""
        close = _OPEN[self.next().text]
        while self.more() and self.peek() != close:
            before = self.at
            self.expression({",", ";", close})
            self.take(",") or self.take(";")
            if self.at == before:
                if self.peek() in _CLOSE:
                    return
                self.skip_tree()
        self.take(close)

    def closure(self) -> None:
        """``|a: T, b| -> R`` up to the body."""
        if self.seq("||"):
            self.at += 2
        else:
            self.at += 1
            while self.more() and self.peek() != "|":
                before = self.at
                self.pattern({":", ",", "|"})
                if self.take(":"):
                    self.type()
                self.take(",")
                if self.at == before:
                    self.skip_tree()
            self.take("|")
        if self.seq("->"):
            self.at += 2
            self.one_type()

    def expression(self, stop: set[str], head: bool = False, statement: bool = False) -> None:
        """Up to one of ``stop`` outside brackets. head: ``{`` ends it and opens no struct body.

        statement: an expression that ends in a block ends there.
        """
        operand = True
        while self.more():
            t, kind = self.peek(), self.kind()
            if kind in ("punct", "ident") and t in stop and not (t == "=" and self.seq("==")):
                return
            if kind == "punct":
                if t in _CLOSE:
                    return
                if t == "{":
                    if not operand:
                        return
                    self.block()
                    operand = False
                    if statement and self.ends_statement():
                        return
                elif t in ("(", "["):
                    self.group()
                    operand = False
                elif t == "|" and operand:
                    self.closure()
                elif t == "#" and operand:
                    self.attribute()
                elif t == "<" and operand:
                    self.path("head" if head else "expr")
                    operand = False
                elif t == "." and not self.seq(".."):
                    self.at += 1
                    if self.kind() in ("ident", "literal"):
                        self.at += 1
                        if self.seq("::") and self.peek(2) == "<":
                            self.at += 2
                            self.arguments()
                    operand = False
                elif t == "?":
                    self.at += 1
                    operand = False
                elif self.seq("::") and operand:
                    self.path("head" if head else "expr")
                    operand = False
                elif self.seq("=>"):
                    return
                elif self.seq(".."):
                    self.at += 3 if self.seq("..=") else 2
                    operand = True
                    if head and self.peek() == "{":
                        return
                else:
                    self.at += 1
                    operand = True
            elif kind == "ident":
                if t == "as":
                    self.at += 1
                    self.one_type()
                    operand = False
                elif t in ("match", "if", "while", "for", "loop", "unsafe", "async", "const", "move", "static", "gen") and self.control(t):
                    if self.tokens[self.at - 1].text == "}":
                        operand = False
                        if statement and self.ends_statement():
                            return
                    else:
                        operand = True
                elif t == "let":
                    self.at += 1
                    self.pattern({"="})
                    self.take("=")
                    operand = True
                elif t in ("return", "break", "continue", "in", "else", "mut", "ref", "true", "false"):
                    self.at += 1
                    operand = t not in ("true", "false", "continue")
                    if t == "break" and self.kind() == "lifetime":
                        self.at += 1
                elif self.path_then_bang():
                    self.macro_call()
                    braces = self.tokens[self.at - 1].text == "}"
                    operand = False
                    if statement and braces and self.ends_statement():
                        return
                elif self.plain() or t == "Self":
                    if not operand:
                        return
                    self.path("head" if head else "expr")
                    operand = False
                else:
                    if t in _ITEM_START and not operand:
                        return
                    self.at += 1
            elif kind == "lifetime":
                self.at += 1
                if self.peek() == ":" and not self.seq("::"):
                    self.at += 1
                    operand = True
            else:
                if not operand:
                    return
                self.at += 1
                operand = False

    def ends_statement(self) -> bool:
        """After a block in statement position: only a method call, ``?`` or ``else`` goes on."""
        return not (self.peek() in (".", "?") and not self.seq("..") or self.peek() == "else")

    def control(self, word: str) -> bool:
        """A control-flow keyword and its blocks; False if it is none here."""
        if word in ("unsafe", "async", "const", "gen", "static", "move"):
            i = 1
            while self.peek(i) in ("move", "async"):
                i += 1
            if self.peek(i) == "{":
                if word == "unsafe":
                    self.facts.edges.append((self.stack[-1], self.stack[-1], "uses_unsafe"))
                self.at += i
                self.block()
                return True
            if self.peek(i) == "|":
                self.at += i
                self.closure()
                return True
            return False
        self.at += 1
        if word == "for":
            if self.peek() == "<":
                self.generics()
                return True
            self.pattern({"in"})
            self.take("in")
        if word in ("match", "if", "while", "for"):
            self.expression(set(), head=True)
        if word == "match":
            if self.peek() == "{":
                self.arms()
            return True
        if self.peek() == "{":
            self.block()
        while word == "if" and self.take("else"):
            if self.peek() == "if":
                self.at += 1
                self.expression(set(), head=True)
            if self.peek() == "{":
                self.block()
            else:
                break
        return True

    def arms(self) -> None:
        self.at += 1
        while self.more() and self.peek() != "}":
            before = self.at
            if self.peek() == "#":
                self.attribute()
                continue
            if self.peek() == ",":
                self.at += 1
                continue
            self.pattern({"if", "="})
            if self.take("if"):
                self.expression(set(), head=False)
            if self.seq("=>"):
                self.at += 2
                if self.peek() == "{":
                    self.block()
                    if self.peek() in (".", "?") and not self.seq(".."):
                        self.expression({",", "}"})
                else:
                    self.expression({",", "}"})
            self.take(",")
            if self.at == before:
                self.skip_tree()
        self.take("}")


def parse(file_id: str, text: str) -> Facts:
    """The facts of one file. Source nested too deeply to parse still gives what came before."""
    limit = sys.getrecursionlimit()
    parser = Parser(file_id, text)
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        parser.items()
    except RecursionError:
        pass
    finally:
        sys.setrecursionlimit(limit)
    return parser.facts
