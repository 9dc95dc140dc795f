"""Chat formatting: a small sandboxed template language compiled to Python closures.

    {{ expression }}   {% for x in list %} {% endfor %}   {% if e %} {% elif e %} {% else %} {% endif %}   {% set x = e %}
    {% generation %} {% endgeneration %}   {# comment #}   `-` inside a tag trims the white space beside it

Expressions: strings, integers, true, false, none, names, x.key, x['key'], x[0], == != < <= > >= in, + ~ and or not, a if b else c,
x | filter (upper, lower, trim, length, title, escape). There is no call, no attribute of Python objects, no import:
a template can only read the values it is given. Text under a generation marker comes back as spans.
"""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import batches_of, letters

#: Strings with a meaning in formatted text; inside texts they follow a backslash, as a backslash itself does.
CONTROLS = ("\\", "###", "</turn>")
_ESCAPE = re.compile("|".join(map(re.escape, CONTROLS)))
_HEAD_ESCAPE = re.compile("|".join(map(re.escape, (*CONTROLS, ":"))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^:\\])*): ((?:\\.|(?!</turn>)[^\\])*)</turn>\n", re.S)

#: Marks turns; only assistants' texts are under the generation marker.
TURNS = """{% for m in messages -%}
### {{ m.role | escape_head }}: {% if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else %}{{ m.text | escape }}{% endif %}</turn>{{ '\\n' }}
{%- endfor %}"""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "upper": str.upper, "lower": str.lower, "trim": str.strip, "title": str.title, "length": len, "escape": escape,
    "escape_head": lambda t: _HEAD_ESCAPE.sub(lambda m: "\\" + m[0], t),
}


class TemplateError(ValueError):
    """A template that cannot be parsed, or that names something it may not."""


# ---- syntax tree: tuples (kind, ...)

_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~|.\[\]()=]))""", re.S)
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
            ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self):
        node = self.either()
        if self.peek("if"):
            self.take("if")
            test = self.either()
            self.take("else")
            return ("choice", test, node, self.choice())
        return node

    def either(self):
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek("not"):
            self.take("not")
            return ("not", self.negated())
        node = self.sum()
        while self.peek(*_COMPARE):
            node = ("compare", self.take(*_COMPARE), node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.peek("+", "~"):
            node = ("add" if self.take("+", "~") == "+" else "join", node, self.filtered())
        return node

    def filtered(self):
        node = self.value()
        while self.peek("|"):
            self.take("|")
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def value(self):
        if self.peek("("):
            self.take("(")
            node = self.choice()
            self.take(")")
        elif self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "str":
                node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "int":
                node = ("const", int(text))
            elif kind == "name" and text in ("true", "false", "none"):
                node = ("const", {"true": True, "false": False, "none": None}[text])
            elif kind == "name":
                node = ("name", text)
            else:
                raise TemplateError(f"unexpected {text!r}")
        else:
            raise TemplateError("expression ends early")
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                node = ("item", node, ("const", self.name()))
            else:
                node = ("item", node, self.choice())
                self.take("]")
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = [p for p in _TAGS.split(source) if p]
    for i, part in enumerate(parts):  # trimming of neighbours
        if part[:3] in ("{{-", "{%-") and i and not parts[i - 1].startswith("{"):
            parts[i - 1] = parts[i - 1].rstrip()
        if part[-3:] in ("-}}", "-%}") and i + 1 < len(parts):
            parts[i + 1] = parts[i + 1].lstrip() if not _TAGS.fullmatch(parts[i + 1]) else parts[i + 1]
    tree, rest = _block(parts, 0, ())
    if rest < len(parts):
        raise TemplateError(f"unexpected {parts[rest]!r}")
    return tree


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    nodes = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{#") and part.endswith("#}"):
            at += 1
        elif part.startswith("{{") and _TAGS.fullmatch(part):
            nodes.append(("print", _Expression(part[2:-2].strip("-")).whole()))
            at += 1
        elif part.startswith("{%") and _TAGS.fullmatch(part):
            inner = part[2:-2].strip("-").strip()
            word = inner.split(None, 1)[0] if inner else ""
            if word in ends:
                return ("block", *nodes), at
            node, at = _statement(word, inner[len(word):], parts, at)
            nodes.append(node)
        else:
            nodes.append(("print", ("const", part)))
            at += 1
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return ("block", *nodes), at


def _statement(word: str, rest: str, parts: list[str], at: int) -> tuple[tuple, int]:
    if word == "for":
        e = _Expression(rest)
        name = e.name()
        e.take("in")
        body, at = _block(parts, at + 1, ("endfor",))
        return ("for", name, e.whole(), body), at + 1
    if word == "if":
        body, at = _block(parts, at + 1, ("elif", "else", "endif"))
        inner = parts[at][2:-2].strip("-").strip()
        if inner.startswith("elif"):
            other, at = _statement("if", inner[4:], parts, at)
            return ("if", _Expression(rest).whole(), body, other), at
        if inner == "else":
            other, at = _block(parts, at + 1, ("endif",))
        else:
            other = ("block",)
        return ("if", _Expression(rest).whole(), body, other), at + 1
    if word == "set":
        e = _Expression(rest)
        name = e.name()
        e.take("=")
        return ("set", name, e.whole()), at + 1
    if word == "generation":
        body, at = _block(parts, at + 1, ("endgeneration",))
        return ("generation", body), at + 1
    raise TemplateError(f"no statement {word!r}")


def fold(node):
    """Constants worked out once: operators on constants, tests on constants, neighbouring constant texts."""
    if not isinstance(node, tuple):
        return node
    node = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    kind, args = node[0], node[1:]
    if kind == "block":
        flat: list = []
        for child in args:
            for x in child[1:] if child[0] == "block" else (child,):
                if x[0] == "print" and x[1][0] == "const" and flat and flat[-1][0] == "print" and flat[-1][1][0] == "const":
                    flat[-1] = ("print", ("const", _text(flat[-1][1][1]) + _text(x[1][1])))
                else:
                    flat.append(x)
        return ("block", *flat)
    if kind in ("if", "choice") and args[0][0] == "const":
        return args[1] if args[0][1] else args[2]
    if kind in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if kind in ("not", "add", "join", "compare", "filter", "item") and all(x[0] == "const" for x in args if isinstance(x, tuple)):
        return ("const", _expression(node)({}))
    return node


# ---- closures

def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _item(value, key):
    if isinstance(value, dict) or isinstance(value, (list, tuple, str)) and isinstance(key, int):
        try:
            return value[key]
        except (KeyError, IndexError):
            return None
    raise TemplateError(f"no item {key!r}")


def _expression(node) -> Callable[[dict], object]:
    kind, *args = node
    if kind == "const":
        value = args[0]
        return lambda env: value
    if kind == "name":
        name = args[0]
        return lambda env: env.get(name)
    if kind == "compare":
        op, a, b = _COMPARE[args[0]], _expression(args[1]), _expression(args[2])
        return lambda env: op(a(env), b(env))
    if kind == "filter":
        filter_, a = FILTERS[args[0]], _expression(args[1])
        return lambda env: filter_(a(env) if args[0] == "length" else _text(a(env)))
    a, *more = map(_expression, args)
    if kind == "not":
        return lambda env: not a(env)
    b = more[0]
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "add":
        return lambda env: a(env) + b(env)
    if kind == "join":
        return lambda env: _text(a(env)) + _text(b(env))
    c = more[1]  # choice
    return lambda env: b(env) if a(env) else c(env)


class _Out:
    """Text written so far and the spans under a generation marker, in code points."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str):
        self.parts.append(text)
        self.length += len(text)


def _render(node) -> Callable[[dict, _Out], None]:
    kind, *args = node
    if kind == "print":
        if args[0][0] == "const":
            text = _text(args[0][1])
            return lambda env, out: out.write(text)
        value = _expression(args[0])
        return lambda env, out: out.write(_text(value(env)))
    if kind == "block":
        steps = [_render(x) for x in args]

        def block(env, out):
            for step in steps:
                step(env, out)
        return block
    if kind == "if":
        test, yes, no = _expression(args[0]), _render(args[1]), _render(args[2])
        return lambda env, out: (yes if test(env) else no)(env, out)
    if kind == "set":
        name, value = args[0], _expression(args[1])
        return lambda env, out: env.__setitem__(name, value(env))
    if kind == "generation":
        body = _render(args[0])

        def generation(env, out):
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))
        return generation
    name, items, body = args[0], _expression(args[1]), _render(args[2])  # for

    def loop(env, out):
        values = items(env) or []
        inner = dict(env)
        for i, value in enumerate(values):
            inner[name] = value
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(values), "length": len(values)}
            body(inner, out)
    return loop


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts) to the rendered text and its generation spans."""
    run = _render(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


# ---- DataFrames

_FORMATTED = pa.schema([("conv", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_chats(df: DataFrame, template: str = TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Render each conversation: (`conv_col`, formatted, spans [start, end) of generated text in code points).

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. Null roles and texts are
    empty. Rows with a null conversation id form one conversation. Other columns are not looked at; an empty table gives an
    empty result. The template is parsed before any row is read; a bad one raises TemplateError.

    Rows are spread by conversation and sorted there, and stream through; one conversation is held at a time.
    """
    compile_template(template)
    kind = df.schema[conv_col].dataType
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), letters(role_col).alias("role"), letters(text_col).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches):
        render = compile_template(template)

        def conversations() -> Iterator[tuple]:
            now, messages = None, []
            for batch in batches:
                for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if messages and conv != now:
                        yield (now, *result(messages))
                        messages = []
                    now = conv
                    messages.append({"role": role, "text": text})
            if messages:
                yield (now, *result(messages))

        def result(messages):
            text, spans = render(messages)
            return text, [{"start": a, "end": b} for a, b in spans]

        return batches_of(conversations(), _FORMATTED, 256)

    out = rows.withColumn("conv", F.col("conv").cast("long")).mapInArrow(run, "conv long, formatted string, spans array<struct<start: bigint, end: bigint>>")
    return out.select(F.col("conv").cast(kind).alias(conv_col), "formatted", "spans")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a text rendered with TURNS."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What `format_chats` with TURNS wrote, read from its output alone: (conv, turns [role, text], loss_text, formatted_chars)."""

    def run(batches):
        def rows():
            for batch in batches:
                for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    turns = [{"role": r, "text": t} for r, t in read_turns(text)]
                    yield conv, turns, "".join(unescape(text[s["start"]:s["end"]]) for s in spans), len(text)

        schema = pa.schema([("conv", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string()),
                            ("formatted_chars", pa.int64())])
        return batches_of(rows(), schema, 256)

    kind = formatted.schema[conv_col].dataType
    out = formatted.select(F.col(conv_col).cast("long").alias("conv"), "formatted", "spans")
    out = out.mapInArrow(run, "conv long, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long")
    return out.select(F.col("conv").cast(kind).alias(conv_col), "turns", "loss_text", "formatted_chars")
