"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and each node becomes a Python
closure; there is no eval, no attribute access and no call but the filters listed here.  Rendering yields the text and the
spans made inside ``{% generation %}`` blocks (the loss mask).

    {{ expr }}            expr: names, "strings", numbers, expr.key, expr + expr, ==, !=, and, or, not, expr | filter
    {% for x in expr %} .. {% endfor %}     {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% set x = expr %}    {% generation %} .. {% endgeneration %}
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches

START, STOP = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}{{ '" + START + "' + (m.role | role) + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '" + STOP + "' + '\\n' }}{% endfor %}"
)
PLANTED = [(role, STOP + START + "assistant ok") for role in ("user", "assistant")]


def escape(s: str) -> str:
    """No ``<|`` is left: a backslash goes between ``<`` and ``|``, after any that stand there."""
    return re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", s)


def unescape(s: str) -> str:
    return re.sub(r"<(\\*)\\\|", lambda m: "<" + m[1] + "|", s)


def escape_role(s: str) -> str:
    """As ``escape``, and on one line: a role ends at the line end."""
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s), flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[()+|.]))", re.S)
_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


class TemplateError(ValueError):
    pass


def _lex(src: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while src[at:].strip():
        m = _TOKEN.match(src, at)
        if not m:
            raise TemplateError(f"cannot read {src[at:]!r}")
        at = m.end()
        num, text, name, op = m.groups()
        if num is not None:
            out.append(("const", int(num)))
        elif text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1], flags=re.S)))
        else:
            out.append(("word", name) if name else ("op", op))
    return [*out, ("end", None)]


class _Expr:
    """Recursive descent: or < and < not < ==,!= < + < | filter < .key"""

    def __init__(self, src: str):
        self.t, self.i = _lex(src), 0

    def take(self, *want) -> bool:
        if self.t[self.i] in want:
            self.i += 1
            return True
        return False

    def whole(self):
        e = self.either()
        if self.t[self.i][0] != "end":
            raise TemplateError(f"unexpected {self.t[self.i][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take(("word", "or")):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.take(("word", "and")):
            e = ("and", e, self.negated())
        return e

    def negated(self):
        return ("not", self.negated()) if self.take(("word", "not")) else self.compared()

    def compared(self):
        e = self.summed()
        for op in ("==", "!="):
            if self.take(("op", op)):
                return (op, e, self.summed())
        return e

    def summed(self):
        e = self.filtered()
        while self.take(("op", "+")):
            e = ("+", e, self.filtered())
        return e

    def filtered(self):
        e = self.single()
        while self.take(("op", "|")):
            kind, name = self.t[self.i]
            if kind != "word" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            e = ("filter", name, e)
        return e

    def single(self):
        kind, x = self.t[self.i]
        self.i += 1
        if kind == "const":
            return ("const", x)
        if kind == "word":
            e = ("name", x)
            while self.take(("op", ".")):
                kind, key = self.t[self.i]
                if kind != "word" or key.startswith("_"):
                    raise TemplateError(f"no key {key!r}")
                self.i += 1
                e = ("key", e, key)
            return e
        if (kind, x) == ("op", "("):
            e = self.either()
            if not self.take(("op", ")")):
                raise TemplateError("missing )")
            return e
        raise TemplateError(f"unexpected {x!r}")


def parse(src: str):
    """Syntax tree of a template."""
    parts, at = [], 0
    for m in _PART.finditer(src):
        if m.start() > at:
            parts.append(("text", src[at : m.start()]))
        parts.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(src):
        parts.append(("text", src[at:]))
    pos = 0

    def block(ends: tuple[str, ...]):
        nonlocal pos
        out = []
        while pos < len(parts):
            kind, x = parts[pos]
            pos += 1
            if kind == "text":
                out.append(("put", ("const", x)))
            elif kind == "put":
                out.append(("put", _Expr(x).whole()))
            else:
                head, _, rest = x.partition(" ")
                if head in ends:
                    return out, head, rest
                if head == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    body, _, _ = block(("endfor",))
                    out.append(("for", m[1], _Expr(m[2]).whole(), ("block", body)))
                elif head == "if":
                    cases, other, cond = [], ("block", []), _Expr(rest).whole()
                    while True:
                        body, end, more = block(("elif", "else", "endif"))
                        if cond is None:
                            other = ("block", body)
                        else:
                            cases.append((cond, ("block", body)))
                        if end == "endif":
                            break
                        cond = _Expr(more).whole() if end == "elif" else None
                    out.append(("if", cases, other))
                elif head == "set":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad set: {rest!r}")
                    out.append(("set", m[1], _Expr(m[2]).whole()))
                elif head == "generation":
                    body, _, _ = block(("endgeneration",))
                    out.append(("gen", ("block", body)))
                else:
                    raise TemplateError(f"no tag {head!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, "", ""

    body, _, _ = block(())
    return ("block", body)


_PURE = {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(e):
    """The tree with constant expressions evaluated, dead branches cut and neighbouring constant output joined."""
    kind = e[0]
    if kind in _PURE:
        a, b = fold(e[1]), fold(e[2])
        return ("const", _PURE[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "not":
        a = fold(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(e[2])
        return ("const", FILTERS[e[1]](a[1])) if a[0] == "const" else ("filter", e[1], a)
    if kind == "key":
        return ("key", fold(e[1]), e[2])
    if kind == "put":
        return ("put", fold(e[1]))
    if kind == "set":
        return ("set", e[1], fold(e[2]))
    if kind == "for":
        return ("for", e[1], fold(e[2]), fold(e[3]))
    if kind == "gen":
        return ("gen", fold(e[1]))
    if kind == "if":
        cases, other = [], fold(e[2])
        for c, body in e[1]:
            c = fold(c)
            if c[0] == "const":
                if c[1]:
                    other = fold(body)
                    break
                continue
            cases.append((c, fold(body)))
        return ("if", cases, other) if cases else other
    if kind == "block":
        out = []
        for x in map(fold, e[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "put" and y[1][0] == "const" and out and out[-1][0] == "put" and out[-1][1][0] == "const":
                    out[-1] = ("put", ("const", str(out[-1][1][1]) + str(y[1][1])))
                else:
                    out.append(y)
        return ("block", out)
    return e


class _Out:
    def __init__(self):
        self.parts, self.n, self.spans, self.depth = [], 0, [], 0

    def put(self, s: str):
        self.parts.append(s)
        self.n += len(s)


def _value(e) -> Callable:
    kind = e[0]
    if kind == "const":
        x = e[1]
        return lambda env: x
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name, "")
    if kind == "key":
        of, key = _value(e[1]), e[2]
        return lambda env: (lambda v: v.get(key, "") if isinstance(v, dict) else "")(of(env))
    if kind == "filter":
        f, a = FILTERS[e[1]], _value(e[2])
        return lambda env: f(a(env))
    if kind == "not":
        a = _value(e[1])
        return lambda env: not a(env)
    a, b = _value(e[1]), _value(e[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    f = _PURE[kind]
    return lambda env: f(a(env), b(env))


def _action(e) -> Callable:
    kind = e[0]
    if kind == "put":
        v = _value(e[1])
        return lambda env, out: out.put(str(v(env)))
    if kind == "set":
        name, v = e[1], _value(e[2])
        return lambda env, out: env.__setitem__(name, v(env))
    if kind == "for":
        name, seq, body = e[1], _value(e[2]), _action(e[3])

        def loop(env, out):
            for x in seq(env) or ():
                body({**env, name: x}, out)

        return loop
    if kind == "if":
        cases, other = [(_value(c), _action(b)) for c, b in e[1]], _action(e[2])

        def branch(env, out):
            for c, b in cases:
                if c(env):
                    return b(env, out)
            return other(env, out)

        return branch
    if kind == "gen":
        body = _action(e[1])

        def mark(env, out):
            at = out.n
            body(env, out)
            out.spans.append((at, out.n))

        return mark
    steps = [_action(x) for x in e[1]]

    def run(env, out):
        for s in steps:
            s(env, out)

    return run


def compile_template(src: str = TEMPLATE) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (text, spans under the loss mask in code points)."""
    run = _action(fold(parse(src)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text made by TEMPLATE."""
    turns = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(STOP)])))
    return turns


def formatted(spark: SparkSession, conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, text, mask array<struct<lo,hi>>`` for every conversation, its rows by turn (null texts and roles: empty).

    Rows of equal turn follow each other by role and text; null turns come first; rows without a conv_id are one
    conversation; other columns are ignored; an empty table gives no row.  A conversation is one output text, so its rows
    meet in one task by nature.
    """
    small_batches(spark)
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("conv_id", F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("ms"))

    def run(batches):
        render = compile_template(template)
        for b in batches:
            text, mask = [], []
            for ms in b.column("ms").to_pylist():
                t, spans = render(ms)
                text.append(t), mask.append([{"lo": lo, "hi": hi} for lo, hi in spans])
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), pa.array(text, pa.string()), pa.array(mask, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["conv_id", "text", "mask"])

    return per.mapInArrow(run, "conv_id long, text string, mask array<struct<lo:long,hi:long>>")


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the formatted texts.

    Conversation -1, whose texts are control strings, is added.
    """
    extra = spark.createDataFrame([(-1, i, r, t) for i, (r, t) in enumerate(PLANTED)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, mask in zip(b.column("text").to_pylist(), b.column("mask").to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[m["lo"] : m["hi"]]) for m in mask)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in out.items())], ["conv_id", *out])

    return formatted(spark, rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
