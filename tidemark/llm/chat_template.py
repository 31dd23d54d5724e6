"""A compiler for a small, sandboxed template language that renders conversations.

    {{ expr }}   {{ expr | escape }}   {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} ... loop.first, loop.last, loop.index ... {% endfor %}
    {% generation %} ... {% endgeneration %}     text under the loss

Expressions: strings, integers, true, false, none, names, ``a.b`` (keys of given values only), ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``,
brackets and the filters escape, trim, upper, lower. There are no calls, imports or Python attributes, so a template reaches nothing that it
was not given. Source becomes a syntax tree, constants are folded, and every node becomes a Python closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|+]))""")
_CONSTANTS = {"true": True, "false": False, "none": None}
FILTERS: dict[str, Callable[[str], str]] = {"trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower()}


class TemplateError(ValueError):
    """The template is not in the language, or asks for what it was not given."""


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    marks: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


# ---- syntax tree: tuples (kind, ...) ----


class _Expression:
    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            text, number, name, sign = m.groups()
            self.items.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1], flags=re.S)) if text else ("const", int(number)) if number else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *want: tuple) -> bool:
        if self.peek() in want:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take(("name", "or")):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take(("name", "and")):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        for sign in ("==", "!="):
            if self.take(("sign", sign)):
                return (sign, tree, self.added())
        return tree

    def added(self) -> tuple:
        tree = self.filtered()
        while self.take(("sign", "+")):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.take(("sign", "|")):
            kind, name = self.peek()
            if kind != "name" or name not in {*FILTERS, "escape"}:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self) -> tuple:
        if self.take(("sign", "(")):
            tree = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError("a bracket is open")
            return tree
        kind, value = self.peek()
        if kind not in ("const", "name"):
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        if kind == "const":
            return ("const", value)
        tree = ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        while self.take(("sign", ".")):
            kind, key = self.peek()
            if kind != "name" or key.startswith("_"):
                raise TemplateError(f"no key {key!r}")
            self.at += 1
            tree = ("get", tree, key)
        return tree


def parse(source: str) -> list[tuple]:
    """Nodes: ('text', s) ('put', e) ('if', [(e, body)...]) ('for', name, e, body) ('generation', body)."""
    tags, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            tags.append(("text", source[at : m.start()]))
        tags.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        tags.append(("text", source[at:]))
    tags.reverse()

    def body(*ends: str) -> tuple[list[tuple], str]:
        out = []
        while tags:
            kind, value = tags.pop()
            if kind == "text":
                out.append(("text", value))
            elif kind == "put":
                out.append(("put", _Expression(value).whole()))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in ends:
                    return out, value
                if word == "if":
                    arms, test = [], value[2:]
                    while True:
                        inner, end = body("elif", "else", "endif")
                        arms.append((_Expression(test).whole(), inner))
                        if end.startswith("elif"):
                            test = end[4:]
                        elif end == "else":
                            inner, end = body("endif")
                            arms.append((("const", True), inner))
                            break
                        else:
                            break
                    out.append(("if", arms))
                elif m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", value, re.S):
                    inner, _ = body("endfor")
                    out.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif value == "generation":
                    inner, _ = body("endgeneration")
                    out.append(("generation", inner))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body()[0]


def _as_text(value: Any) -> str:
    return "" if value is None else str(value)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {"+": lambda a, b: _as_text(a) + _as_text(b) if isinstance(a, str) or isinstance(b, str) else a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def fold(tree: tuple) -> tuple:
    """Work out what does not depend on the input."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "get":
        return ("get", fold(tree[1]), tree[2])
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](_as_text(inner[1]))) if inner[0] == "const" and tree[1] in FILTERS else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold(tree[1]), fold(tree[2])
    if kind in ("and", "or") and a[0] == "const":
        return b if bool(a[1]) == (kind == "and") else a
    if kind in _BINARY and a[0] == b[0] == "const":
        return ("const", _BINARY[kind](a[1], b[1]))
    return (kind, a, b)


def fold_body(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []

    def push(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "put":
            tree = fold(node[1])
            push(("text", _as_text(tree[1])) if tree[0] == "const" else ("put", tree))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    push(x)
            elif arms:
                push(("if", arms))
        elif node[0] == "for":
            push(("for", node[1], fold(node[2]), fold_body(node[3])))
        elif node[0] == "generation":
            push(("generation", fold_body(node[1])))
        else:
            push(node)
    return out


# ---- closures ----


def _value(tree: tuple, escape: Callable[[str], str]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        def look(env: dict, name: str = tree[1]) -> Any:
            if name not in env:
                raise TemplateError(f"no value {name!r}")
            return env[name]

        return look
    if kind == "get":
        inner = _value(tree[1], escape)

        def get(env: dict, key: str = tree[2]) -> Any:
            held = inner(env)
            if not isinstance(held, dict) or key not in held:
                raise TemplateError(f"no key {key!r}")
            return held[key]

        return get
    if kind == "filter":
        change, inner = (escape if tree[1] == "escape" else FILTERS[tree[1]]), _value(tree[2], escape)
        return lambda env: change(_as_text(inner(env)))
    a = _value(tree[1], escape)
    if kind == "not":
        return lambda env: not a(env)
    b = _value(tree[2], escape)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    apply = _BINARY[kind]
    return lambda env: apply(a(env), b(env))


def _body(nodes: list[tuple], escape: Callable[[str], str]) -> Callable[[dict, Output], None]:
    steps = [_step(n, escape) for n in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: tuple, escape: Callable[[str], str]) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, text=node[1]: out.add(text)
    if kind == "put":
        value = _value(node[1], escape)
        return lambda env, out: out.add(_as_text(value(env)))
    if kind == "generation":
        inner = _body(node[1], escape)

        def generation(env: dict, out: Output) -> None:
            began = out.size
            inner(env, out)
            out.marks.append((began, out.size))

        return generation
    if kind == "if":
        arms = [(_value(t, escape), _body(b, escape)) for t, b in node[1]]

        def choose(env: dict, out: Output) -> None:
            for test, run in arms:
                if test(env):
                    run(env, out)
                    return

        return choose
    name, items, inner = node[1], _value(node[2], escape), _body(node[3], escape)

    def loop(env: dict, out: Output) -> None:
        rows = items(env)
        for k, x in enumerate(rows):
            inner(env | {name: x, "loop": {"first": k == 0, "last": k == len(rows) - 1, "index": k + 1}}, out)

    return loop


@lru_cache(maxsize=16)
def compile_template(source: str, escape: Callable[[str], str] = lambda text: text) -> Callable[..., Output]:
    """A renderer: keyword values in; text parts, size in code points and loss marks out."""
    run = _body(fold_body(parse(source)), escape)

    def render(**values: Any) -> Output:
        out = Output()
        run(values, out)
        return out

    return render
