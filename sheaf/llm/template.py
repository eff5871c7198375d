r"""A small sandboxed template language, compiled to Python closures.

    {{ value }}                              the text of a value
    {% for m in list %} .. {% endfor %}      loop.index0, loop.first, loop.last
    {% if a %} .. {% elif b %} .. {% else %} .. {% endif %}
    {% set name = value %}
    {% generation %} .. {% endgeneration %}  marks what a model is trained on

Values are 'strings', integers, true, false, none, names, ``name.key`` of a
mapping, ``a | filter``, ``+`` and ``~`` (joining), ``== != and or not in`` and
parentheses.  There are no calls, no Python attributes and no other names than
those given: an unknown name, filter or tag is an error of compilation.

A template is parsed to a syntax tree, constant parts are folded, and each node
becomes a closure.  Rendering is lazy: it yields (text, generated) pieces and
takes the loop's items from any iterator one at a time (with one ahead for
``loop.last``), so a long conversation is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Apply:
    """An operation on values: of OPERATIONS, or a filter."""
    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    cases: tuple[tuple[object, tuple], ...]  # (condition, body), the last may be Const(True)


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def text_of(value: object) -> str:
    return "" if value is None else {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: text_of(a) in text_of(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else text_of(a) + text_of(b),
    "~": lambda a, b: text_of(a) + text_of(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}
FILTERS: dict[str, Callable[[object], str]] = {
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
}

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op>==|!=|[|+~()]))")
_ESCAPES = {"n": "\n", "t": "\t", "'": "'", "\\": "\\"}
_WORDS = {"true": True, "false": False, "none": None}


class _Values:
    """Recursive descent over the tokens of one value."""

    def __init__(self, source: str, known: set[str], filters: dict):
        self.known, self.filters, self.tokens, at = known, filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in a value: {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))

    def whole(self):
        value = self._or()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return value

    def _take(self, *values: str) -> str | None:
        kind, value = self.tokens[0]
        if value in values and kind in ("op", "name"):
            self.tokens.pop(0)
            return value
        return None

    def _left(self, below: Callable, *operators: str):
        value = below()
        while op := self._take(*operators):
            value = Apply(op, (value, below()))
        return value

    def _or(self):
        return self._left(self._and, "or")

    def _and(self):
        return self._left(self._not, "and")

    def _not(self):
        return Apply("not", (self._not(),)) if self._take("not") else self._left(self._sum, "==", "!=", "in")

    def _sum(self):
        return self._left(self._filtered, "+", "~")

    def _filtered(self):
        value = self._one()
        while self._take("|"):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            value = Apply(name, (value,))
        return value

    def _one(self):
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if value == "(":
            inner = self._or()
            if not self._take(")"):
                raise TemplateError("a parenthesis is not closed")
            return inner
        if kind != "name":
            raise TemplateError(f"unexpected {value or 'end of a value'!r}")
        if value in _WORDS:
            return Const(_WORDS[value])
        path = tuple(value.split("."))
        if path[0] not in self.known:
            raise TemplateError(f"unknown name {path[0]!r}")
        return Name(path)


def parse(source: str, names: Iterable[str], filters: dict | None = None) -> tuple:
    """The syntax tree of a template that may use the given names."""
    filters = FILTERS | (filters or {})
    parts = [p for p in _PARTS.split(source) if p]
    known = set(names)

    def value(text: str):
        return _Values(text, known, filters).whole()

    def body(ends: tuple[str, ...]) -> tuple[tuple, str, str]:
        """Nodes up to one of the tags that end them, that tag and its rest."""
        out = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                out.append(Output(value(part[2:-2])))
            elif part.startswith("{%"):
                tag, _, rest = part[2:-2].strip().partition(" ")
                if tag in ends:
                    return tuple(out), tag, rest
                out.append(statement(tag, rest))
            else:
                out.append(Output(Const(part)))
        if ends != ("",):
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), "", ""

    def statement(tag: str, rest: str):
        if tag == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            items, outer = value(m[2]), set(known)
            known.update((m[1], "loop"))
            inner = body(("endfor",))[0]
            known.intersection_update(outer)
            return For(m[1], items, inner)
        if tag == "if":
            cases, condition, tag = [], value(rest), "if"
            while tag != "endif":
                inner, tag, rest = body(("elif", "else", "endif") if condition != Const(True) or tag != "else" else ("endif",))
                cases.append((condition, inner))
                condition = value(rest) if tag == "elif" else Const(True)
            return If(tuple(cases))
        if tag == "set":
            name, sign, rest = rest.partition("=")
            if not sign or not name.strip().isidentifier():
                raise TemplateError(f"set {name}")
            node = Set(name.strip(), value(rest))
            known.add(node.name)
            return node
        if tag == "generation":
            return Generation(body(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {tag!r}")

    return body(("",))[0]


def fold(node, filters: dict | None = None):
    """The same tree with constant values computed, constant conditions
    decided and neighbouring texts joined."""
    filters = FILTERS | (filters or {})

    def value(v):
        if not isinstance(v, Apply):
            return v
        args = tuple(map(value, v.args))
        if all(isinstance(a, Const) for a in args):
            return Const({**OPERATIONS, **filters}[v.name](*(a.value for a in args)))
        return Apply(v.name, args)

    def nodes(body: tuple) -> tuple:
        out: list = []
        for n in body:
            if isinstance(n, Output):
                v = value(n.value)
                n = Output(Const(text_of(v.value)) if isinstance(v, Const) else v)
                if isinstance(n.value, Const):
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        n = Output(Const(out.pop().value.value + n.value.value))
                    if not n.value.value:
                        continue
            elif isinstance(n, If):
                cases = []
                for condition, inner in n.cases:
                    condition = value(condition)
                    if isinstance(condition, Const) and not condition.value:
                        continue
                    cases.append((condition, nodes(inner)))
                    if isinstance(condition, Const):
                        break
                if not cases:
                    continue
                if isinstance(cases[0][0], Const) and not any(isinstance(x, Set) for x in cases[0][1]):
                    out += cases[0][1]
                    continue
                n = If(tuple(cases))
            elif isinstance(n, For):
                n = For(n.name, value(n.items), nodes(n.body))
            elif isinstance(n, Set):
                n = Set(n.name, value(n.value))
            elif isinstance(n, Generation):
                n = Generation(nodes(n.body))
            out.append(n)
        return tuple(out)

    return nodes(node)


Piece = tuple[str, bool]


def compile_template(source: str, names: Iterable[str], filters: dict | None = None) -> Callable[[dict], Iterator[Piece]]:
    """render(values) -> (text, generated) pieces, lazily."""
    filters = FILTERS | (filters or {})
    tree = fold(parse(source, names, filters), filters)

    def value(v) -> Callable[[dict], object]:
        if isinstance(v, Const):
            return lambda env: v.value
        if isinstance(v, Name):
            first, *rest = v.path

            def look(env):
                got = env[first]
                for key in rest:
                    got = got.get(key) if isinstance(got, dict) else None
                return got
            return look
        args = [value(a) for a in v.args]
        if v.name == "and":
            return lambda env: args[0](env) and args[1](env)
        if v.name == "or":
            return lambda env: args[0](env) or args[1](env)
        f = {**OPERATIONS, **filters}[v.name]
        return (lambda env: f(args[0](env))) if len(args) == 1 else lambda env: f(args[0](env), args[1](env))

    def block(body: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
        steps = [node(n) for n in body]

        def run(env, generated):
            for step in steps:
                yield from step(env, generated)
        return run

    def node(n) -> Callable[[dict, bool], Iterator[Piece]]:
        if isinstance(n, Output):
            get = value(n.value)

            def put(env, generated):
                yield text_of(get(env)), generated
            return put
        if isinstance(n, Set):
            get = value(n.value)

            def assign(env, generated):
                env[n.name] = get(env)
                yield from ()
            return assign
        if isinstance(n, Generation):
            inner = block(n.body)
            return lambda env, generated: inner(env, True)
        if isinstance(n, If):
            cases = [(value(c), block(b)) for c, b in n.cases]

            def choose(env, generated):
                for condition, inner in cases:
                    if condition(env):
                        yield from inner(env, generated)
                        return
            return choose
        items, inner = value(n.items), block(n.body)

        def loop(env, generated):
            source, index, none = iter(items(env) or ()), 0, object()
            item = next(source, none)
            while item is not none:
                then = next(source, none)
                yield from inner({**env, n.name: item, "loop": {"index0": index, "first": index == 0, "last": then is none}}, generated)
                item, index = then, index + 1
        return loop

    whole = block(tree)
    return lambda values: whole(dict(values), False)
