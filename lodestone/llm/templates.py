"""A small sandboxed template language for conversations: parsed into a syntax tree, folded, and compiled to closures.

Text stands for itself. ``{{ expression }}`` prints, ``{# ... #}`` is a comment, and statements are ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% endif %}``, ``{% for x in xs %}`` (with ``loop.index``, ``loop.index0``,
``loop.first`` and ``loop.last``), ``{% endfor %}``, ``{% set x = expression %}``, ``{% generation %}`` and
``{% endgeneration %}``. A ``-`` inside a delimiter strips the white space beside it. Expressions have literals, lists,
names, ``a.b`` and ``a[b]``, arithmetic, ``~``, comparisons, ``in``, ``is defined`` and ``is none``, ``not``, ``and``,
``or``, ``a if b else c`` and filters. Nothing can be called, fields are looked up in mappings and lists only, and numbers
alone can be multiplied, so that a template reaches neither Python objects nor memory beyond its data.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


class TemplateError(ValueError):
    """What is wrong with a template, or with the values that it is rendered with."""


class _Undefined:
    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = _Undefined()


# --- syntax tree -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Apply:
    """An operator or a filter on its arguments."""

    kind: str
    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- values ----------------------------------------------------------------------------------------------------------


def _text(v: Any) -> str:
    return v if isinstance(v, str) else "" if v is None else str(v)


def _number(v: Any) -> int | float:
    if isinstance(v, (int, float)):
        return v
    raise TemplateError(f"not a number: {v!r}")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, list) and isinstance(b, list):
        return a + b
    return _number(a) + _number(b)


def _over(f: Callable) -> Callable:
    def divide(a, b):
        if not _number(b):
            raise TemplateError("division by zero")
        return f(_number(a), b)

    return divide


def _checked(f: Callable) -> Callable:
    def compare(*args):
        try:
            return f(*args)
        except TypeError as e:
            raise TemplateError(str(e)) from None

    return compare


def _field(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return UNDEFINED


OPERATORS: dict[str, Callable] = {
    "+": _plus, "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b), "/": _over(operator.truediv),
    "//": _over(operator.floordiv), "%": _over(operator.mod), "~": lambda a, b: _text(a) + _text(b), "==": operator.eq, "!=": operator.ne,
    "<": _checked(operator.lt), "<=": _checked(operator.le), ">": _checked(operator.gt), ">=": _checked(operator.ge), "in": _checked(lambda a, b: a in b),
    "neg": lambda a: -_number(a), "not": operator.not_, "defined": lambda a: a is not UNDEFINED, "none": lambda a: a is None,
}

FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "string": _text,
    "length": _checked(len), "first": lambda v: _field(v, 0), "last": lambda v: _field(v, -1), "join": lambda v, by="": _text(by).join(map(_text, v)),
    "default": lambda v, other="": other if v is UNDEFINED or v is None else v, "tojson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True),
    "replace": lambda v, old, new: _text(v).replace(_text(old), _text(new)),
}


# --- parser ----------------------------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{-?(?P<print>.*?)-?\}\}|\{%-?(?P<say>.*?)-?%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>=()\[\].,|]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.source, self.filters, self.tokens, at = source, filters, [], 0
        while source[at:].strip():
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unreadable: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value: str | None = None) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind and value in (None, self.tokens[self.at][1]):
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"{value or kind} expected in {self.source!r}")

    def whole(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return out

    def choice(self) -> Any:
        out = self.logic("or", lambda: self.logic("and", self.negation))
        if self.take("if"):
            test = self.logic("or", lambda: self.logic("and", self.negation))
            self.need("name", "else")
            return Choice(test, out, self.choice())
        return out

    def logic(self, word: str, below: Callable) -> Any:
        out = below()
        while self.take(word):
            out = Apply("logic", word, (out, below()))
        return out

    def negation(self) -> Any:
        return Apply("operator", "not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        out = self.chain(("~",), lambda: self.chain(("+", "-"), lambda: self.chain(("*", "/", "//", "%"), self.unary)))
        if self.take("is"):
            no = self.take("not")
            test = self.need("name")
            if test not in ("defined", "none"):
                raise TemplateError(f"no test {test!r}")
            out = Apply("operator", test, (out,))
            return Apply("operator", "not", (out,)) if no else out
        no = self.peek("not")
        op = (self.take("not") and self.take("in")) if no else self.take("==", "!=", "<", "<=", ">", ">=", "in")
        if no and not op:
            raise TemplateError(f"in expected after not in {self.source!r}")
        if op:
            out = Apply("operator", op, (out, self.chain(("~",), lambda: self.chain(("+", "-"), lambda: self.chain(("*", "/", "//", "%"), self.unary)))))
        return Apply("operator", "not", (out,)) if no else out

    def chain(self, ops: tuple[str, ...], below: Callable) -> Any:
        out = below()
        while op := self.take(*ops):
            out = Apply("operator", op, (out, below()))
        return out

    def unary(self) -> Any:
        return Apply("operator", "neg", (self.unary(),)) if self.take("-") else self.postfix()

    def postfix(self) -> Any:
        out = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                key = self.need("name")
                if key.startswith("_"):
                    raise TemplateError(f"no field {key!r}")
                out = Field(out, Const(key))
            elif op == "[":
                out = Field(out, self.choice())
                self.need("op", "]")
            else:
                name, args = self.need("name"), []
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.choice())
                        if not self.peek(")"):
                            self.need("op", ",")
                out = Apply("filter", name, (out, *args))
        return out

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if value == "(":
            out = self.choice()
            self.need("op", ")")
            return out
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.peek("]"):
                    self.need("op", ",")
            return ListOf(tuple(items))
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")


def parse(source: str, filters: dict[str, Callable]) -> tuple:
    """The statements of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        text = source[at : m.start()]
        if parts and parts[-1][0] == "strip":
            text = text.lstrip()
            parts.pop()
        if m[0][2] == "-":
            text = text.rstrip()
        parts.append(("text", text))
        for kind in ("print", "say"):
            if m[kind] is not None:
                parts.append((kind, m[kind].strip()))
        if m[0][-3] == "-":
            parts.append(("strip", ""))
        at = m.end()
    tail = source[at:]
    if parts and parts[-1][0] == "strip":
        tail = tail.lstrip()
        parts.pop()
    parts = [p for p in [*parts, ("text", tail)] if p[0] != "text" or p[1]]
    body, left = _block(parts, 0, (), filters)
    if left < len(parts):
        raise TemplateError(f"unexpected {parts[left][1]!r}")
    return body


def _block(parts: list, at: int, ends: tuple[str, ...], filters: dict) -> tuple[tuple, int]:
    """Statements up to one of the words ``ends``, and the place of that word."""
    expression = lambda s: _Expression(s, filters).whole()
    out: list = []
    while at < len(parts):
        kind, source = parts[at]
        word, _, rest = source.partition(" ") if kind == "say" else ("", "", "")
        if kind == "say" and word in ends:
            return tuple(out), at
        at += 1
        if kind == "text":
            out.append(Print(Const(source)))
        elif kind == "print":
            out.append(Print(expression(source)))
        elif word == "if":
            node, at = _if(parts, at, rest, filters)
            out.append(node)
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"unreadable: {source!r}")
            body, at = _block(parts, at, ("else", "endfor"), filters)
            other: tuple = ()
            if parts[at][1] == "else":
                other, at = _block(parts, at + 1, ("endfor",), filters)
            out.append(For(m[1], expression(m[2]), body, other))
            at += 1
        elif word == "set":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(?!=)(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"unreadable: {source!r}")
            out.append(Set(m[1], expression(m[2])))
        elif word == "generation":
            body, at = _block(parts, at, ("endgeneration",), filters)
            out.append(Generation(body))
            at += 1
        else:
            raise TemplateError(f"no statement {source!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(out), at


def _if(parts: list, at: int, test: str, filters: dict) -> tuple[If, int]:
    then, at = _block(parts, at, ("elif", "else", "endif"), filters)
    word, _, rest = parts[at][1].partition(" ")
    other: tuple = ()
    if word == "elif":
        node, at = _if(parts, at + 1, rest, filters)
        return If(_Expression(test, filters).whole(), then, (node,)), at
    if word == "else":
        other, at = _block(parts, at + 1, ("endif",), filters)
    return If(_Expression(test, filters).whole(), then, other), at + 1


# --- folding ---------------------------------------------------------------------------------------------------------


def names_of(node: Any) -> Iterator[Any]:
    """Every node below and including ``node``."""
    if isinstance(node, tuple):
        for x in node:
            yield from names_of(x)
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            yield from names_of(getattr(node, f.name))


def fold(body: tuple, filters: dict[str, Callable]) -> tuple:
    """The same statements with constants worked out: expressions without names, names that are set once at the top to a
    constant, branches that can't be taken, and neighbouring pieces of text."""
    bound = [n.name for n in names_of(body) if isinstance(n, (Set, For))]
    known: dict[str, Const] = {}
    out = []
    for statement in body:
        new = _fold_statement(statement, known, filters)
        for n in new:
            if isinstance(n, Set) and isinstance(n.value, Const) and bound.count(n.name) == 1:
                known[n.name] = n.value
            else:
                out.append(n)
    return _joined(out)


def _joined(body: list) -> tuple:
    out: list = []
    for n in body:
        if isinstance(n, Print) and isinstance(n.value, Const):
            text = _text(n.value.value)
            if out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                out[-1] = Print(Const(out[-1].value.value + text))
            elif text:
                out.append(Print(Const(text)))
        else:
            out.append(n)
    return tuple(out)


def _fold_statement(n: Any, known: dict, filters: dict) -> list:
    block = lambda b: _joined([x for s in b for x in _fold_statement(s, known, filters)])
    value = lambda e: _fold_value(e, known, filters)
    if isinstance(n, Print):
        return [Print(value(n.value))]
    if isinstance(n, Set):
        return [Set(n.name, value(n.value))]
    if isinstance(n, Generation):
        body = block(n.body)
        return [Generation(body)] if body else []
    if isinstance(n, If):
        test = value(n.test)
        if isinstance(test, Const):
            return list(block(n.then if test.value else n.other))
        return [If(test, block(n.then), block(n.other))]
    items = value(n.items)
    if isinstance(items, Const) and not items.value:
        return list(block(n.other))
    return [For(n.name, items, block(n.body), block(n.other))]


def _fold_value(n: Any, known: dict, filters: dict) -> Any:
    value = lambda e: _fold_value(e, known, filters)
    if isinstance(n, Name):
        return known.get(n.name, n)
    if isinstance(n, Field):
        n = Field(value(n.of), value(n.key))
        parts = (n.of, n.key)
    elif isinstance(n, ListOf):
        n = ListOf(tuple(map(value, n.items)))
        parts = n.items
    elif isinstance(n, Apply):
        n = replace(n, args=tuple(map(value, n.args)))
        parts = n.args
        if n.kind == "logic" and isinstance(n.args[0], Const):
            return n.args[1] if bool(n.args[0].value) == (n.name == "and") else n.args[0]
    elif isinstance(n, Choice):
        test = value(n.test)
        if isinstance(test, Const):
            return value(n.then if test.value else n.other)
        return Choice(test, value(n.then), value(n.other))
    else:
        return n
    return Const(_value(n, filters)({})) if all(isinstance(p, Const) for p in parts) else n


# --- closures --------------------------------------------------------------------------------------------------------

#: What rendering yields between texts where the text of a generation begins and ends.
BEGIN, END = object(), object()


def _value(n: Any, filters: dict) -> Callable[[dict], Any]:
    """A closure that gives the value of an expression."""
    if isinstance(n, Const):
        v = n.value
        return lambda env: v
    if isinstance(n, Name):
        name = n.name
        return lambda env: env.get(name, UNDEFINED)
    if isinstance(n, ListOf):
        items = [_value(x, filters) for x in n.items]
        return lambda env: [f(env) for f in items]
    if isinstance(n, Choice):
        test, then, other = (_value(x, filters) for x in (n.test, n.then, n.other))
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(n, Field):
        of, key = _value(n.of, filters), _value(n.key, filters)
        return lambda env: _field(of(env), key(env))
    args = [_value(x, filters) for x in n.args]
    if n.kind == "logic":
        a, b = args
        return (lambda env: a(env) and b(env)) if n.name == "and" else (lambda env: a(env) or b(env))
    f = OPERATORS[n.name] if n.kind == "operator" else filters[n.name]
    if len(args) == 1:
        one = args[0]
        return lambda env: f(one(env))
    return lambda env: f(*[x(env) for x in args])


def _body(body: tuple, filters: dict) -> Callable[[dict], Iterator]:
    steps = [(isinstance(n, Print), _statement(n, filters)) for n in body]

    def run(env):
        for prints, f in steps:
            if prints:
                yield f(env)
            else:
                yield from f(env)

    return run


def _statement(n: Any, filters: dict) -> Callable:
    if isinstance(n, Print):
        if isinstance(n.value, Const):
            text = _text(n.value.value)
            return lambda env: text
        value = _value(n.value, filters)
        return lambda env: _text(value(env))
    if isinstance(n, Set):
        name, value = n.name, _value(n.value, filters)

        def put(env):
            env[name] = value(env)
            return ()

        return put
    if isinstance(n, If):
        test, then, other = _value(n.test, filters), _body(n.then, filters), _body(n.other, filters)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(n, Generation):
        inner = _body(n.body, filters)

        def generation(env):
            yield BEGIN
            yield from inner(env)
            yield END

        return generation
    name, items, body, other = n.name, _value(n.items, filters), _body(n.body, filters), _body(n.other, filters)

    def loop(env):
        over = items(env)
        if isinstance(over, (str, _Undefined)) or over is None or not hasattr(over, "__iter__"):
            raise TemplateError("for needs a list")
        it, k = iter(over), 0
        item = next(it, UNDEFINED)
        if item is UNDEFINED:
            yield from other(env)
        while item is not UNDEFINED:
            after = next(it, UNDEFINED)
            yield from body(env | {name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is UNDEFINED}})
            item, k = after, k + 1

    return loop


class Template:
    """A compiled template. ``render(messages)`` yields texts, and BEGIN and END around what a model should generate.

    ``streams`` says that ``messages`` is read once, from its first to its last: then any iterator will do, and a
    conversation of any length needs the memory of two messages. Otherwise it has to be a list.
    """

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        known = FILTERS | (filters or {})
        self.tree = fold(parse(source, known), known)
        uses = [n for n in names_of(self.tree) if n == Name("messages")]
        once = [n for n in self.tree if isinstance(n, For) and n.items == Name("messages")]
        self.streams = len(uses) == len(once) == 1
        self._run = _body(self.tree, known)

    def render(self, messages: Any, **more: Any) -> Iterator:
        return self._run({"messages": messages if self.streams else list(messages), **more})
