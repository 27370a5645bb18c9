"""Chat formatting with compiled templates.

A template is text with ``{{ expression }}``, ``{% for NAME in EXPRESSION %}``, ``{% if %}``/``{% elif %}``/``{% else %}``,
``{% set NAME = EXPRESSION %}``, ``{% generation %}`` blocks and ``{# comments #}``; a dash inside a tag strips white space
on that side. Expressions have literals, names, ``a.b``, ``a['b']``, comparisons, ``and or not``, ``+ ~ %``, ``x if c else y``
and the filters in ``FILTERS``. Nothing else can be reached: no attributes of Python objects, no calls, no imports. A
template becomes a syntax tree, constant parts are folded, and every node becomes a Python closure that yields
(text, generated) parts, so a conversation of any length is rendered in bounded memory.

Conversations are rows of turns. Turns are put in order by Spark (range-free, by key and sort), and each task streams
through its conversations; nothing gathers a conversation's rows.
"""

from __future__ import annotations

import ast
import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAT_TEMPLATE = (
    "{%- for message in messages -%}"
    "{{ '<|im_start|>' ~ message.role|name ~ '\\n' }}"
    "{%- if message.role == 'assistant' -%}"
    "{% generation %}{{ message.text|escape }}{% endgeneration %}"
    "{%- else -%}{{ message.text|escape }}{%- endif -%}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{%- endfor -%}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Without control marks: a backslash is doubled, and one is put between ``<`` and ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_name(text: str) -> str:
    return escape(text).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def unescape_name(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)), "name": lambda x: escape_name(str(x)), "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len,
}
Part = tuple[str, bool]
Closure = Callable[[dict], object]


class Constant(NamedTuple):
    value: object


class Node(NamedTuple):
    """``kind`` with its parts: expressions, names or lists of nodes."""

    kind: str
    parts: tuple


_TAGS = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
_COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt,
    ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}


def _split_outside(source: str, mark: str) -> list[str]:
    """Parts of an expression between ``mark`` where it isn't in quotes or brackets."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(source):
        ch = source[i]
        if quote:
            i += ch == "\\"
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == mark and not depth:
            out.append(source[start:i])
            start = i + 1
        i += 1
    return [*out, source[start:]]


def parse_expression(source: str) -> Constant | Node:
    """``a ~ b`` joins texts and binds least, then come filters, then Python-like expressions."""
    joined = _split_outside(source, "~")
    if len(joined) > 1:
        return Node("join", tuple(parse_expression(x) for x in joined))
    base, *filters = _split_outside(source, "|")
    try:
        tree = ast.parse(base.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as bad:
        raise TemplateError(f"not an expression: {source!r}") from bad
    node = _expression(tree)
    for name in filters:
        if name.strip() not in FILTERS:
            raise TemplateError(f"no filter {name.strip()!r}")
        node = Node("filter", (name.strip(), node))
    return node


def _expression(tree: ast.AST) -> Constant | Node:
    match tree:
        case ast.Constant(value=str() | int() | float() | bool() | None):
            return Constant(tree.value)
        case ast.Name():
            return Node("name", (tree.id,))
        case ast.Attribute():
            return Node("item", (_expression(tree.value), Constant(tree.attr)))
        case ast.Subscript():
            return Node("item", (_expression(tree.value), _expression(tree.slice)))
        case ast.BoolOp():
            return Node("and" if isinstance(tree.op, ast.And) else "or", tuple(map(_expression, tree.values)))
        case ast.UnaryOp(op=ast.Not()):
            return Node("not", (_expression(tree.operand),))
        case ast.UnaryOp(op=ast.USub()):
            return Node("minus", (_expression(tree.operand),))
        case ast.BinOp(op=ast.Add() | ast.Mod()):
            kind = "add" if isinstance(tree.op, ast.Add) else "mod"
            return Node(kind, (_expression(tree.left), _expression(tree.right)))
        case ast.Compare(ops=[op], comparators=[right]) if type(op) in _COMPARE:
            return Node("compare", (_COMPARE[type(op)], _expression(tree.left), _expression(right)))
        case ast.IfExp():
            return Node("choose", (_expression(tree.test), _expression(tree.body), _expression(tree.orelse)))
    raise TemplateError(f"not allowed in a template: {type(tree).__name__}")


def parse(template: str) -> list[Node]:
    """Syntax tree of a template."""
    tokens, at, strip = [], 0, False
    for m in _TAGS.finditer(template):
        text = template[at: m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[0][2] == "-" else text
        if text:
            tokens.append(("text", text))
        if m[1] is not None:
            tokens.append(("tag", m[1]))
        elif m[2] is not None:
            tokens.append(("print", m[2]))
        at, strip = m.end(), m[0][-3] == "-"
    rest = template[at:].lstrip() if strip else template[at:]
    tokens += [("text", rest)] if rest else []
    nodes, end = _block(tokens, 0, ())
    if end != len(tokens):
        raise TemplateError(f"unexpected {tokens[end][1]!r}")
    return nodes


def _block(tokens: list, at: int, ends: tuple[str, ...]) -> tuple[list[Node], int]:
    nodes: list[Node] = []
    while at < len(tokens):
        kind, body = tokens[at]
        word, _, rest = body.partition(" ")
        at += 1
        if kind == "text":
            nodes.append(Node("print", (Constant(body),)))
        elif kind == "print":
            nodes.append(Node("print", (parse_expression(body),)))
        elif word in ends:
            return nodes, at - 1
        elif word == "for" and (m := re.fullmatch(r"(\w+) in (.+)", rest, re.S)):
            inner, at = _closed(tokens, at, "endfor")
            nodes.append(Node("for", (m[1], parse_expression(m[2]), inner)))
        elif word == "generation":
            inner, at = _closed(tokens, at, "endgeneration")
            nodes.append(Node("generation", (inner,)))
        elif word == "set" and (m := re.fullmatch(r"(\w+) = (.+)", rest, re.S)):
            nodes.append(Node("set", (m[1], parse_expression(m[2]))))
        elif word == "if":
            node, at = _if(tokens, at, rest)
            nodes.append(node)
        else:
            raise TemplateError(f"unexpected tag {body!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return nodes, at


def _closed(tokens: list, at: int, end: str) -> tuple[list[Node], int]:
    nodes, at = _block(tokens, at, (end,))
    return nodes, at + 1


def _if(tokens: list, at: int, condition: str) -> tuple[Node, int]:
    then, at = _block(tokens, at, ("elif", "else", "endif"))
    word, _, rest = tokens[at][1].partition(" ")
    if word == "elif":
        other, at = _if(tokens, at + 1, rest)
        return Node("if", (parse_expression(condition), then, [other])), at
    other = []
    if word == "else":
        other, at = _block(tokens, at + 1, ("endif",))
    return Node("if", (parse_expression(condition), then, other)), at + 1


def fold(node):
    """The same tree with constant expressions computed, constant conditions decided and neighbouring texts joined."""
    if isinstance(node, list):
        out: list[Node] = []
        for x in (y for part in map(fold, node) for y in (part if isinstance(part, list) else [part])):
            if out and x.kind == out[-1].kind == "print" and isinstance(x.parts[0], Constant) \
                    and isinstance(out[-1].parts[0], Constant):
                out[-1] = Node("print", (Constant(str(out[-1].parts[0].value) + str(x.parts[0].value)),))
            else:
                out.append(x)
        return out
    if not isinstance(node, Node):
        return node
    parts = tuple(fold(p) if isinstance(p, (Node, list)) else p for p in node.parts)
    if node.kind == "join":
        merged: list = []
        for p in parts:
            if merged and isinstance(p, Constant) and isinstance(merged[-1], Constant):
                merged[-1] = Constant(str(merged[-1].value) + str(p.value))
            else:
                merged.append(p)
        parts = tuple(merged)
        if len(parts) == 1 and isinstance(parts[0], Constant):
            return parts[0]
    if node.kind == "if" and isinstance(parts[0], Constant):
        return parts[1] if parts[0].value else parts[2]
    folded = Node(node.kind, parts)
    if node.kind in _VALUES and all(isinstance(p, Constant) for p in parts if isinstance(p, (Constant, Node))):
        try:
            return Constant(expression_closure(folded)({}))
        except Exception:  # it fails when rendered, if it ever is
            return folded
    return folded


_VALUES = {"join", "filter", "item", "and", "or", "not", "minus", "add", "mod", "compare", "choose"}


def _item(value, key):
    if isinstance(value, (dict, list, tuple, str)):
        try:
            return value[key]
        except (KeyError, IndexError, TypeError):
            return ""
    return ""


def expression_closure(node: Constant | Node) -> Closure:
    if isinstance(node, Constant):
        value = node.value
        return lambda env: value
    kind, parts = node
    if kind == "name":
        name = parts[0]
        return lambda env: env.get(name, "")
    if kind == "filter":
        apply, inner = FILTERS[parts[0]], expression_closure(parts[1])
        return lambda env: apply(inner(env))
    if kind == "compare":
        test, left, right = parts[0], expression_closure(parts[1]), expression_closure(parts[2])
        return lambda env: test(left(env), right(env))
    inner = [expression_closure(p) for p in parts]
    if kind == "join":
        return lambda env: "".join([str(f(env)) for f in inner])
    first, second = inner[0], inner[min(1, len(inner) - 1)]
    if kind == "and":
        return lambda env: all(f(env) for f in inner)
    if kind == "or":
        return lambda env: next((v for f in inner if (v := f(env))), "")
    if kind == "choose":
        third = inner[2]
        return lambda env: second(env) if first(env) else third(env)
    return {
        "item": lambda env: _item(first(env), second(env)), "not": lambda env: not first(env),
        "minus": lambda env: -first(env), "add": lambda env: first(env) + second(env),
        "mod": lambda env: first(env) % second(env),
    }[kind]


def block_closure(nodes: list[Node]) -> Callable[[dict, bool], Iterator[Part]]:
    """A function from variables and the current mask to the rendered parts."""
    steps = [_step(node) for node in nodes]

    def run(env: dict, generated: bool) -> Iterator[Part]:
        for step in steps:
            yield from step(env, generated)

    return run


def _step(node: Node) -> Callable[[dict, bool], Iterator[Part]]:
    kind, parts = node
    if kind == "print":
        value = expression_closure(parts[0])

        def show(env, generated):
            yield str(value(env)), generated
        return show
    if kind == "set":
        name, value = parts[0], expression_closure(parts[1])

        def assign(env, generated):
            env[name] = value(env)
            return iter(())
        return assign
    if kind == "generation":
        inner = block_closure(parts[0])
        return lambda env, generated: inner(env, True)
    if kind == "if":
        test, then, other = expression_closure(parts[0]), block_closure(parts[1]), block_closure(parts[2])
        return lambda env, generated: (then if test(env) else other)(env, generated)
    name, items, inner = parts[0], expression_closure(parts[1]), block_closure(parts[2])

    def loop(env, generated):
        own = dict(env)
        rows = iter(items(env))
        following = next(rows, None)
        index = 0
        while following is not None:
            current, following = following, next(rows, None)
            own[name] = current
            own["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": following is None}
            index += 1
            yield from inner(own, generated)
    return loop


class Template:
    """A compiled template; it is sent to tasks as its source."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self.run = block_closure(self.tree)

    def __reduce__(self):
        return Template, (self.source,)

    def render(self, messages, **variables) -> Iterator[Part]:
        """(text, under the loss mask) in order; ``messages`` may be an iterator of dictionaries."""
        return self.run({"messages": messages, **variables}, False)


TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


class Digest:
    """Reads formatted text back part by part; what it holds at once is bounded by the longest turn."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.open = ""

    def add(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        if generated:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode("utf-8", "replace"))
        self.open += text
        if text.endswith("<|im_end|>\n"):
            at = 0
            for m in TURN.finditer(self.open):
                if m.start() != at:
                    raise ValueError("the formatted text has something between turns")
                at = m.end()
                self.turns += 1
                turn = f"{unescape_name(m[1])}\n{unescape(m[2])}\n"
                self.turn_hash.update(turn.encode("utf-8", "replace"))
            self.open = self.open[at:]

    def row(self, conv_id) -> tuple:
        if self.open:
            raise ValueError("the formatted text ends within a turn")
        return (conv_id, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars)


def _streamed(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for part in parts:
        keys = zip(part["none"], part["conv_id"], strict=True)
        yield from zip(
            [None if none else int(k) for none, k in keys], [r if isinstance(r, str) else "" for r in part["role"]],
            [t if isinstance(t, str) else "" for t in part["text"]], strict=True)


def conversations_in_order(turns: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order; ties of turn go by role, then text, null turns first.

    A null id is 0 with ``none`` set, as a null among ids would turn them to floating point on their way to Python.
    """
    conv = F.col("conv_id").cast("long")
    rows = turns.select(F.coalesce(conv, F.lit(0)).alias("conv_id"), conv.isNull().alias("none"), "turn", "role", "text")
    return rows.repartition("none", "conv_id").sortWithinPartitions("none", "conv_id", "turn", "role", "text")


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, messages); each conversation's messages must be used up before the next is asked for."""
    from itertools import groupby

    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, ({"role": role, "text": text} for _, role, text in group)


def _ids(rows: list[tuple]) -> pd.Series:
    """First values of the rows, as integers that may be null."""
    return pd.Series([row[0] for row in rows], dtype="Int64")


def formatted_parts(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """(conv_id, part, text, generated): the formatted conversations, in parts that join to the whole.

    Null roles and texts are empty; rows with a null conv_id are one conversation; an empty table gives an empty one.
    """
    compiled = Template(template)

    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for key, messages in _conversations(_streamed(parts)):
            for number, (text, generated) in enumerate(compiled.render(messages)):
                rows.append((key, number, text, generated))
                if len(rows) == 2_000:
                    yield pd.DataFrame(rows, columns=["conv_id", "part", "text", "generated"]).assign(conv_id=_ids(rows))
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "part", "text", "generated"]).assign(conv_id=_ids(rows))

    return conversations_in_order(turns).mapInPandas(render, "conv_id long, part long, text string, generated boolean")


DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def format_report(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its formatted text while that is rendered.

    n_turns, turns_sha256 (role, line break, text, line break of every turn), loss_chars and loss_sha256 (code points and
    digest of the unescaped text under the mask), formatted_chars. Nulls, ties and empty tables as in the functions above;
    repeated rows are turns of their own; other columns aren't read. A conversation is hashed in order by one task,
    as a stream: memory is bounded by its longest turn.
    """
    compiled = Template(template)

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for key, messages in _conversations(_streamed(parts)):
            found = Digest()
            for text, generated in compiled.render(messages):
                found.add(text, generated)
            rows.append(found.row(key))
            if len(rows) == 5_000:
                yield pd.DataFrame(rows, columns=DIGEST).assign(conv_id=_ids(rows))
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=DIGEST).assign(conv_id=_ids(rows))

    return conversations_in_order(turns).mapInPandas(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
