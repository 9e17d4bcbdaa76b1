"""A small sandboxed template language, compiled to Python closures.

Text stands for itself.  ``{{ expression }}`` prints, ``{# ... #}`` is left out, and the tags are::

    {% for name in expression %} ... {% endfor %}      loop.first, loop.last and loop.index0 are set inside
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}           marks what a model is to generate

Expressions are strings, whole numbers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of
mappings only), ``==``, ``!=``, ``not``, ``and``, ``or``, ``+`` (joins text) and filters behind ``|``.
There are no calls, no attributes of Python objects and no loops but over what is passed in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

_PARTS = re.compile(r"\{\{(?P<show>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.+()\[\]=]))")


class TemplateError(ValueError):
    """The template does not follow the language."""


@dataclass(frozen=True)
class Escapes:
    """Reversible marks for control strings inside texts; none may hold a backslash."""

    controls: tuple[str, ...]

    def __post_init__(self) -> None:
        if any("\\" in c or not c for c in self.controls) or len(self.controls) > 26:
            raise TemplateError("control strings hold no backslash, and there are at most 26")

    def hide(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for i, control in enumerate(self.controls):
            text = text.replace(control, "\\" + chr(97 + i))
        return text

    def show(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else self.controls[ord(m[1]) - 97], text, flags=re.S)


@dataclass
class Output:
    """Text rendered so far, and the code-point spans under generation marks."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


# --- syntax tree -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or filter on its arguments."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class Put:
    name: str
    value: object


@dataclass(frozen=True)
class Choose:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Mark:
    body: tuple


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"cannot print a {type(value).__name__}")


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: _text(a) + _text(b), "not": lambda a: not a,
    "trim": lambda a: _text(a).strip(), "upper": lambda a: _text(a).upper(), "lower": lambda a: _text(a).lower(),
    "capitalize": lambda a: _text(a).capitalize(), "length": lambda a: len(a or ""),
}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted is not None and self.peek() != wanted:
            raise TemplateError(f"expected {wanted or 'more'} in expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> object:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in expression")
        return out

    def either(self) -> object:
        left = self.both()
        while self.peek() == "or":
            self.take()
            left = Apply("or", (left, self.both()))
        return left

    def both(self) -> object:
        left = self.negated()
        while self.peek() == "and":
            self.take()
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self) -> object:
        if self.peek() == "not":
            self.take()
            return Apply("not", (self.negated(),))
        left = self.joined()
        if self.peek() in ("==", "!="):
            return Apply(self.take()[1], (left, self.joined()))
        return left

    def joined(self) -> object:
        left = self.filtered()
        while self.peek() == "+":
            self.take()
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self) -> object:
        left = self.item()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in ("trim", "upper", "lower", "capitalize", "length", "escape"):
                raise TemplateError(f"unknown filter {name}")
            left = Apply(name, (left,))
        return left

    def item(self) -> object:
        kind, word = self.take()
        if kind == "text":
            out = Const(word[1:-1])
        elif kind == "number":
            out = Const(int(word))
        elif word == "(":
            out = self.either()
            self.take(")")
        elif kind == "name":
            out = Const({"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else Name(word)
        else:
            raise TemplateError(f"unexpected {word!r} in expression")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, word = self.take()
                if kind != "name":
                    raise TemplateError("a name must follow the point")
                out = Key(out, Const(word))
            else:
                out = Key(out, self.either())
                self.take("]")
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    stack: list[tuple[str, dict, list]] = [("", {}, [])]
    at = 0

    def close(kind: str) -> tuple[dict, tuple]:
        name, info, body = stack.pop()
        if name != kind:
            raise TemplateError(f"end of {kind} without its start")
        return info, tuple(body)

    for m in _PARTS.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Text(source[at : m.start()]))
        at = m.end()
        if m["show"] is not None:
            stack[-1][2].append(Show(_Expression(m["show"]).whole()))
        elif m["tag"] is not None:
            word, _, rest = m["tag"].strip().partition(" ")
            if word == "for":
                loop = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not loop:
                    raise TemplateError("for needs a name and what to loop over")
                stack.append(("for", {"name": loop[1], "over": _Expression(loop[2]).whole()}, []))
            elif word == "endfor":
                info, body = close("for")
                stack[-1][2].append(Loop(info["name"], info["over"], body))
            elif word == "if":
                stack.append(("if", {"done": [], "test": _Expression(rest).whole()}, []))
            elif word in ("elif", "else"):
                info, body = close("if")
                info["done"].append((info["test"], body))
                info["test"] = _Expression(rest).whole() if word == "elif" else Const(True)
                stack.append(("if", info, []))
            elif word == "endif":
                info, body = close("if")
                stack[-1][2].append(Choose((*info["done"], (info["test"], body))))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                    raise TemplateError("set needs a name")
                stack[-1][2].append(Put(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                stack.append(("generation", {}, []))
            elif word == "endgeneration":
                stack[-2][2].append(Mark(close("generation")[1]))
            else:
                raise TemplateError(f"unknown tag {word}")
    if at < len(source):
        stack[-1][2].append(Text(source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return tuple(stack[0][2])


# --- constant folding ------------------------------------------------------------------------------


def _fold_value(node: object, escapes: Escapes) -> object:
    if isinstance(node, Key):
        return Key(_fold_value(node.of, escapes), _fold_value(node.key, escapes))
    if not isinstance(node, Apply):
        return node
    args = tuple(_fold_value(a, escapes) for a in node.args)
    if node.op in ("and", "or"):
        first = args[0]
        if isinstance(first, Const):
            return args[1] if bool(first.value) == (node.op == "and") else first
    elif all(isinstance(a, Const) for a in args):
        return Const(_operation(node.op, escapes)(*(a.value for a in args)))
    return Apply(node.op, args)


def fold(body: tuple, escapes: Escapes) -> tuple:
    """The same tree with constant expressions evaluated, dead branches dropped and neighbouring text joined."""
    out: list = []
    for node in body:
        if isinstance(node, Show):
            value = _fold_value(node.value, escapes)
            node = Text(_text(value.value)) if isinstance(value, Const) else Show(value)
        elif isinstance(node, Put):
            node = Put(node.name, _fold_value(node.value, escapes))
        elif isinstance(node, Loop):
            node = Loop(node.name, _fold_value(node.over, escapes), fold(node.body, escapes))
        elif isinstance(node, Mark):
            node = Mark(fold(node.body, escapes))
        elif isinstance(node, Choose):
            branches = []
            for test, inner in node.branches:
                test = _fold_value(test, escapes)
                if isinstance(test, Const) and not test.value:
                    continue
                branches.append((test, fold(inner, escapes)))
                if isinstance(test, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    _append(out, inner)
                continue
            if not branches:
                continue
            node = Choose(tuple(branches))
        _append(out, node)
    return tuple(out)


def _append(out: list, node: object) -> None:
    if isinstance(node, Text) and not node.text:
        return
    if isinstance(node, Text) and out and isinstance(out[-1], Text):
        node = Text(out.pop().text + node.text)
    out.append(node)


# --- closures --------------------------------------------------------------------------------------


def _operation(op: str, escapes: Escapes) -> Callable:
    return (lambda a: escapes.hide(_text(a))) if op == "escape" else _OPS[op]


def _key(of: object, key: object) -> object:
    return of.get(key) if isinstance(of, Mapping) else None


def _value(node: object, escapes: Escapes) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Key):
        of, key = _value(node.of, escapes), _value(node.key, escapes)
        return lambda scope: _key(of(scope), key(scope))
    args = [_value(a, escapes) for a in node.args]
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    run = _operation(node.op, escapes)
    if len(args) == 1:
        return lambda scope, a=args[0]: run(a(scope))
    return lambda scope, a=args[0], b=args[1]: run(a(scope), b(scope))


def _body(nodes: tuple, escapes: Escapes) -> Callable[[dict, Output], None]:
    steps = [_step(n, escapes) for n in nodes]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return steps[0] if len(steps) == 1 else run


def _step(node: object, escapes: Escapes) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        return lambda scope, out, t=node.text: out.add(t)
    if isinstance(node, Show):
        value = _value(node.value, escapes)
        return lambda scope, out: out.add(_text(value(scope)))
    if isinstance(node, Put):
        value = _value(node.value, escapes)
        return lambda scope, out, n=node.name: scope.__setitem__(n, value(scope))
    if isinstance(node, Mark):
        inner = _body(node.body, escapes)

        def mark(scope: dict, out: Output) -> None:
            first = out.size
            inner(scope, out)
            out.spans.append((first, out.size))

        return mark
    if isinstance(node, Choose):
        branches = [(_value(test, escapes), _body(body, escapes)) for test, body in node.branches]

        def choose(scope: dict, out: Output) -> None:
            for test, body in branches:
                if test(scope):
                    body(scope, out)
                    return

        return choose
    over, body = _value(node.over, escapes), _body(node.body, escapes)

    def loop(scope: dict, out: Output) -> None:
        items = list(over(scope) or ())
        for i, item in enumerate(items):
            body(scope | {node.name: item, "loop": {"first": i == 0, "last": i == len(items) - 1, "index0": i}}, out)

    return loop


class Template:
    """A compiled template.

    ``render`` gives the text and spans of a whole conversation.  ``turn`` gives those of one message,
    with what stands in front of the loop over ``messages`` on the first and what follows it on the last,
    so that the turns of a conversation can be rendered by different tasks; the template's top level must
    then hold exactly one loop over ``messages``.  Names set in front of the loop are known in every turn.
    """

    def __init__(self, source: str, controls: tuple[str, ...] = ()):
        self.source, self.controls, self.escapes = source, controls, Escapes(controls)
        self.tree = fold(parse(source), self.escapes)
        self._all = _body(self.tree, self.escapes)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, Loop) and n.over == Name("messages")]
        self.by_turn = len(loops) == 1
        if self.by_turn:
            at = loops[0]
            self._name = self.tree[at].name
            self._before, self._after = _body(self.tree[:at], self.escapes), _body(self.tree[at + 1 :], self.escapes)
            self._turn = _body(self.tree[at].body, self.escapes)

    def __reduce__(self):
        return Template, (self.source, self.controls)

    def render(self, messages: list[dict], **names: object) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self._all(names | {"messages": messages}, out)
        return out.text(), out.spans

    def turn(self, message: dict, index: int, last: bool, **names: object) -> tuple[str, list[tuple[int, int]]]:
        if not self.by_turn:
            raise TemplateError("the template's top level needs one loop over messages")
        out, scope = Output(), dict(names)
        self._before(scope, out)
        if index:
            out = Output()
        self._turn(scope | {self._name: message, "loop": {"first": index == 0, "last": last, "index0": index}}, out)
        if last:
            self._after(scope, out)
        return out.text(), out.spans
