"""JavaScript and TypeScript functions as feature rows, from a tokenizer and bracket matching instead of a full parser.

Source becomes tokens, tokens nested groups of brackets. Functions, methods and arrow functions bound to a name are found by the
few forms in which they are written; a body is split into statements at semicolons, blocks and line ends that can't continue.
That reads ordinary code; decorators, JSX text and exotic forms are passed over, not misread as functions.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from .python_code import shape, with_detail, words

UNKNOWN = "UNKNOWN"
TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v\xa0﻿]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<template>`(?:\\.|[^`\\])*`?)|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<name>#?[A-Za-z_$][\w$]*)"
    r"|(?P<sign>=>|\.\.\.|\?\.|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%<>=!&|^~?:;,.(){}\[\]@])|(?P<other>.)",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words that aren't names, statement kinds, and signs that are operators of the tree.
KEYWORDS = set("async await break case catch class const continue debugger default delete do else export extends finally for function get if import in instanceof interface let new of return set static super switch this throw try typeof type var void while with yield enum abstract public private protected readonly override declare null true false undefined".split())
KINDS = {"if": "IF", "for": "LOOP", "while": "LOOP", "do": "LOOP", "switch": "SWITCH", "try": "TRY", "throw": "RAISE", "function": "DEFINE", "class": "DEFINE", "break": "BREAK", "continue": "CONTINUE", "import": "IMPORT", "delete": "DELETE", "enum": "DEFINE", "interface": "DEFINE", "type": "DEFINE", "debugger": "OTHER"}
CONTROL = {"if": "BRANCH", "switch": "BRANCH", "for": "LOOP", "while": "LOOP", "do": "LOOP", "try": "TRY", "catch": "CATCH", "await": "AWAIT"}
OPERATORS = set("+ - * / % ** << >> & | ^ ~ ! && || ?? == != === !== < > <= >= ++ -- += -= *= /= %= **= &&= ||= ??= in instanceof typeof void".split())
ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&&=", "||=", "??=", "<<=", ">>=", "&=", "|=", "^="}
CONTINUES = OPERATORS | ASSIGNS | {",", ".", "?.", "?", ":", "=>", "(", "[", "{", "...", "=", "@"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    fresh: bool  # first on its line


@dataclass
class Group:
    sign: str
    items: list
    line: int
    end: int
    fresh: bool
    kind: str = "group"
    text: str = ""


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, fresh = 0, 1, True
    while at < len(source):
        m = TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        last = out[-1] if out else None
        if text[0] == "/" and kind == "sign" and (last is None or (last.kind == "sign" and last.text not in (")", "]", "}")) or last.text in ("return", "typeof", "case", "in", "of")) and (r := REGEX.match(source, at)):
            kind, text = "regex", r[0]
        if kind == "line":
            fresh = True
        elif kind not in ("space", "comment"):
            out.append(Token(kind, text, line, fresh))
            fresh = False
        elif kind == "comment" and "\n" in text:
            fresh = True
        line += text.count("\n")
        at += len(text)
    return out


def grouped(flat: list[Token]) -> list:
    """Tokens with brackets as groups; brackets that don't match raise SyntaxError."""
    top: list = []
    stack: list[tuple[list, Token | None]] = [(top, None)]
    for t in flat:
        if t.kind == "sign" and t.text in PAIRS:
            stack.append(([], t))
        elif t.kind == "sign" and t.text in PAIRS.values():
            items, start = stack.pop()
            if start is None or PAIRS[start.text] != t.text:
                raise SyntaxError(f"unmatched {t.text}", ("", t.line, 0, ""))
            stack[-1][0].append(Group(start.text, items, start.line, t.line, start.fresh))
        else:
            stack[-1][0].append(t)
    if len(stack) > 1:
        raise SyntaxError(f"unclosed {stack[-1][1].text}", ("", stack[-1][1].line, 0, ""))
    return top


def is_group(x, sign: str) -> bool:
    return isinstance(x, Group) and x.sign == sign


def is_sign(x, *texts: str) -> bool:
    return isinstance(x, Token) and x.kind in ("sign", "name") and x.text in texts


def split(items: list, sign: str) -> list[list]:
    out: list[list] = [[]]
    for x in items:
        if is_sign(x, sign):
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


def written(items: list) -> str:
    """Tokens as text, for types."""
    out = []
    for x in items:
        out.append(x.sign + written(x.items) + PAIRS[x.sign] if isinstance(x, Group) else x.text)
    return " ".join(out).replace(" ", "") if len(out) < 2 or not all(re.match(r"\w", o) for o in out) else " ".join(out)


@dataclass
class Function:
    name: str
    params: Group
    result: list
    body: Group | list
    start: int
    end: int
    is_async: bool
    scope: tuple[str, ...]
    public: bool = False


def body_end(body) -> int:
    if isinstance(body, Group):
        return body.end
    last = body[-1]
    return last.end if isinstance(last, Group) else last.line


def expression(items: list, i: int) -> list:
    """The expression from i to a comma, a semicolon or a line end that can't continue."""
    out: list = []
    while i < len(items) and not is_sign(items[i], ",", ";"):
        if out and items[i].fresh and not continues(out[-1], items[i]):
            break
        out.append(items[i])
        i += 1
    return out


def continues(before, after) -> bool:
    """Whether a line end between two items can't end a statement."""
    return (isinstance(before, Token) and before.text in CONTINUES and before.kind != "string") or (isinstance(after, Token) and after.kind == "sign" and after.text in CONTINUES | {")", "]", "}"} and after.text not in ("++", "--", "!", "~", "@")) or is_sign(after, "in", "instanceof", "of")


def returned(items: list, i: int) -> tuple[list, int]:
    """A return type after ":" up to "=>" or a body."""
    out: list = []
    if i < len(items) and is_sign(items[i], ":"):
        i += 1
        while i < len(items) and not is_sign(items[i], "=>", ";") and not (is_group(items[i], "{") and out and not is_sign(out[-1], "|", "&", ":")):
            out.append(items[i])
            i += 1
    return out, i


def past_generics(items: list, j: int) -> int:
    """The place after type parameters at j, if there are any."""
    depth, k = 0, j
    while k < len(items):
        depth += is_sign(items[k], "<") - is_sign(items[k], ">") - 2 * is_sign(items[k], ">>")
        k += 1
        if depth <= 0:
            break
    return k if j < len(items) and is_sign(items[j], "<") and depth <= 0 else j


def functions(items: list, scope: tuple[str, ...] = (), in_class: bool = False) -> list[Function]:
    found: list[Function] = []
    i = 0
    while i < len(items):
        x = items[i]
        before = items[i - 1] if i else None
        is_async = is_sign(before, "async")
        start = before.line if is_async else x.line
        exported = any(is_sign(y, "export") for y in items[max(0, i - 4) : i])
        if is_sign(x, "class") and i + 1 < len(items):
            name = items[i + 1].text if isinstance(items[i + 1], Token) and items[i + 1].kind == "name" else ""
            j = next((k for k in range(i + 1, len(items)) if is_group(items[k], "{")), None)
            if j is not None:
                found += functions(items[j].items, (*scope, name) if name else scope, True)
                i = j + 1
                continue
        name, p = "", None  # the name that is bound and where the parameters stand
        if is_sign(x, "function"):
            j = i + 1 + (i + 1 < len(items) and is_sign(items[i + 1], "*"))
            if j < len(items) and isinstance(items[j], Token) and items[j].kind == "name":
                name, p = items[j].text, j + 1
        elif isinstance(x, Token) and x.kind == "name" and (x.text not in KEYWORDS or (in_class and x.text in ("get", "set", "delete", "of", "type"))):
            j = past_generics(items, i + 1)
            if j < len(items) and is_group(items[j], "(") and (in_class or not is_sign(before, ".", "?.", "new")):
                _, k = returned(items, j + 1)
                if k < len(items) and is_group(items[k], "{") and (in_class or is_sign(before, ",", "async") or before is None):
                    name, p = x.text, j
            elif j < len(items) and is_sign(items[j], "=", ":"):
                k = next((k for k in range(j, min(j + 40, len(items))) if is_sign(items[k], "=") or (k > j and is_sign(items[k], ";", ","))), None) if is_sign(items[j], ":") else j
                k = k if k is not None and is_sign(items[k], "=") else j
                k += 1
                if k < len(items) and is_sign(items[k], "async"):
                    is_async, k = True, k + 1
                k = past_generics(items, k)
                if k < len(items) and is_sign(items[k], "function"):
                    k += 1
                    while k < len(items) and not is_group(items[k], "("):
                        k += 1
                if k < len(items) and (is_group(items[k], "(") or (isinstance(items[k], Token) and items[k].kind == "name" and k + 1 < len(items) and is_sign(items[k + 1], "=>"))):
                    name, p, start = x.text, k, x.line
        if name and p is not None and p < len(items):
            p = past_generics(items, p)
            params = items[p] if p < len(items) and is_group(items[p], "(") else Group("(", [items[p]], items[p].line, items[p].line, False) if p < len(items) else None
            if params is not None:
                result, k = returned(items, p + 1)
                body = None
                if k < len(items) and is_sign(items[k], "=>"):
                    k += 1
                    if k < len(items):
                        body = items[k] if is_group(items[k], "{") else expression(items, k)
                elif k < len(items) and is_group(items[k], "{"):
                    body = items[k]
                if body is not None and (isinstance(body, Group) or body):
                    found.append(Function(name, params, result, body, start, body_end(body), is_async, scope, exported or (in_class and not name.startswith("#") and not any(is_sign(y, "private", "protected") for y in items[max(0, i - 4) : i]))))
                    found += functions(body.items if isinstance(body, Group) else body, (*scope, name))
                    i = k + (1 if isinstance(body, Group) else len(body))
                    continue
        if isinstance(x, Group):
            found += functions(x.items, scope)
        i += 1
    return found


def statements(items: list) -> list[list]:
    out: list[list] = []
    i = 0
    while i < len(items):
        if is_sign(items[i], ";"):
            i += 1
            continue
        one = [items[i]]
        i += 1
        block = is_sign(one[0], "if", "for", "while", "switch", "try", "do", "function", "class") or (is_sign(one[0], "async", "export") and i < len(items) and is_sign(items[i], "function", "class"))
        while i < len(items) and not is_sign(items[i], ";"):
            x = items[i]
            if block and is_group(one[-1], "{") and not is_sign(x, "else", "catch", "finally", "while"):
                break
            if not block and x.fresh and not continues(one[-1], x):
                break
            one.append(x)
            i += 1
        out.append(one)
    return out


def flat(items: list):
    """Tokens of nested items, opening and closing signs of groups included."""
    for x in items:
        if isinstance(x, Group):
            yield Token("sign", x.sign, x.line, x.fresh)
            yield from flat(x.items)
            yield Token("sign", PAIRS[x.sign], x.end, False)
        else:
            yield x


@dataclass
class Call:
    receiver: list[str]
    name: str
    args: list[list]


@dataclass
class Body:
    f: Function
    args: dict[str, str] = field(default_factory=dict)
    locals: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.types, self.defaults = [], {}
        for k, p in enumerate(split(self.f.params.items, ",")):
            p = [x for x in p if not is_sign(x, "public", "private", "protected", "readonly", "...")]
            cut = next((i for i, x in enumerate(p) if is_sign(x, "=")), None)
            if cut is not None:
                d = p[cut + 1 :]
                self.defaults[f"ARG{k}"] = self.constant(d[0]) if len(d) == 1 and not isinstance(d[0], Group) and self.constant(d[0]) else "DEFAULT_EXPRESSION"
                p = p[:cut]
            colon = next((i for i, x in enumerate(p) if is_sign(x, ":")), None)
            self.types.append(written(p[colon + 1 :]) if colon is not None else UNKNOWN)
            for x in flat(p[:colon] if colon is not None else p):
                if x.kind == "name" and x.text not in KEYWORDS - {"this"}:
                    self.args[x.text] = f"ARG{k}"
        self.result = written(self.f.result) or UNKNOWN
        body = self.f.body
        self.statements = statements(body.items) if isinstance(body, Group) else [[Token("name", "return", self.f.end, True), *body]]
        everything = list(flat([x for s in self.statements for x in s]))
        for a, b in zip(everything, everything[1:], strict=False):
            if a.kind == "name" and a.text in ("const", "let", "var", "catch") and b.kind == "name":
                self.locals.add(b.text)
        for k, t in enumerate(everything):  # destructured names, and those of inner functions
            if t.text in ("const", "let", "var") and k + 1 < len(everything) and everything[k + 1].text in ("{", "["):
                for u in everything[k + 2 :]:
                    if u.text in ("}", "]"):
                        break
                    if u.kind == "name":
                        self.locals.add(u.text)
        self.locals -= set(self.args)
        self.roles: dict[str, str] = {}
        exact, self.keys, self.spans = [], [], []
        for s in self.statements:
            marks, loose = self.marks(list(flat(s)))
            exact += marks
            self.keys.append(digest(loose, 8))
            self.spans.append((s[0].line, body_end(s)))
        self.size = 1 + len(exact)
        self.body_hash = digest(exact, 16)
        texts = [t.text for t in everything if t.kind in ("name", "sign")]
        self.controls = sorted({CONTROL[t] for t in texts if t in CONTROL})
        self.branches, self.loops, self.returns = sum(t in ("if", "case", "catch", "?") for t in texts), sum(t in ("for", "while", "do") for t in texts), texts.count("return")
        self.calls = [c for s in self.statements for c in self.calls_of(s)]

    @staticmethod
    def constant(t) -> str:
        if t.kind in ("string", "template"):
            return "CONST_STR"
        if t.kind == "number":
            return "CONST_NUM"
        return {"true": "CONST_BOOL_TRUE", "false": "CONST_BOOL_FALSE", "null": "CONST_NONE", "undefined": "CONST_NONE"}.get(t.text, "")

    def role_of_name(self, name: str) -> str:
        if name not in self.roles:
            self.roles[name] = self.args.get(name) or (f"LOCAL{sum(r.startswith('LOCAL') for r in self.roles.values())}" if name in self.locals else f"FREE:{name}")
        return self.roles[name]

    def marks(self, ts: list[Token]) -> tuple[list[str], list[str]]:
        """Exact and loose marks of tokens: literals by kind only, names by role; loose ones hide free names that aren't called."""
        exact, loose = [], []
        for k, t in enumerate(ts):
            after, before = ts[k + 1].text if k + 1 < len(ts) else "", ts[k - 1].text if k else ""
            if t.kind in ("string", "template", "number", "regex") or self.constant(t):
                mark = f"Literal:{self.constant(t) or t.kind}"
                exact.append(mark)
                loose.append("_")
                continue
            if t.kind != "name" or t.text in KEYWORDS or before in (".", "?."):
                mark = t.text
                exact.append(mark)
                loose.append(mark)
                continue
            mark = self.role_of_name(t.text)
            exact.append(mark)
            loose.append("_" if mark.startswith("FREE:") and after != "(" else mark)
        return exact, loose

    def arg_reads(self, items: list) -> list[str]:
        ts = list(flat(items))
        found = {self.args[t.text] for k, t in enumerate(ts) if t.kind == "name" and t.text in self.args and (not k or ts[k - 1].text not in (".", "?."))}
        return sorted(found, key=lambda r: int(r[3:]))

    def role(self, items: list) -> str:
        reads = self.arg_reads(items)
        if reads:
            return reads[0] if len(reads) == 1 else "ARG_MIXED"
        first = items[0]
        if len(items) == 1 and not isinstance(first, Group):
            return self.constant(first) or ("LOCAL" if first.text in self.locals else "IDENTIFIER")
        if is_group(items[-1], "("):
            return "CALL_RESULT"
        return "LOCAL_ATTR" if isinstance(first, Token) and first.text in self.locals else "OBJECT" if is_group(first, "{") else "ARRAY" if is_group(first, "[") else "EXPRESSION"

    def calls_of(self, items: list) -> list[Call]:
        out: list[Call] = []
        for k, x in enumerate(items):
            if not isinstance(x, Group):
                continue
            before = items[k - 1] if k else None
            if x.sign == "(" and isinstance(before, Token) and before.kind == "name" and before.text not in KEYWORDS - {"super"}:
                chain, j = [before.text], k - 2
                while j >= 1 and is_sign(items[j], ".", "?.") and isinstance(items[j - 1], Token) and items[j - 1].kind == "name":
                    chain.insert(0, items[j - 1].text)
                    j -= 2
                out.append(Call(chain[:-1], chain[-1], split(x.items, ",")))
            out += self.calls_of(x.items)
        return out

    def token(self, c: Call) -> str:
        base, name = c.receiver[:1], "_".join(words(c.name))
        receiver = []
        if base:
            root = self.args.get(base[0]) or ("LOCAL" if base[0] in self.locals else "CONTEXT")
            namespace = [".".join(words(base[0]))] if root == "CONTEXT" and len(c.receiver) == 1 and base[0] != "this" else []
            receiver = [*namespace, ".".join([root, *(c.receiver if root == "CONTEXT" else c.receiver[1:])])]
        return f"{'.'.join([*receiver, name])}(args={','.join(self.role(a) for a in c.args)};kwargs=)"

    def statement(self, s: list) -> str:
        first = s[0]
        if is_sign(first, "return"):
            return with_detail("RETURN", ",".join(sorted(self.arg_reads(s[1:]))))
        if is_sign(first, "const", "let", "var"):
            return "ASSIGN:BIND" if any(is_sign(x, "=") for x in s) else "DECLARE"
        if isinstance(first, Token) and first.kind == "name" and first.text in KINDS:
            return KINDS[first.text]
        signs = [x.text for x in s if isinstance(x, Token) and x.kind == "sign"]
        if any(t in ASSIGNS for t in signs):
            return "ASSIGN:BIND" if "=" in signs else "ASSIGN:UPDATE"
        if "++" in signs or "--" in signs:
            return "ASSIGN:UPDATE"
        rest = s[1:] if is_sign(first, "await", "void") else s
        if rest and is_group(rest[-1], "(") and (calls := self.calls_of(rest)):
            outer = [c for c in calls if c.args == split(rest[-1].items, ",")]
            if outer:
                return f"CALL:{self.token(outer[0])}"
        return "EXPR"

    def tree(self) -> dict:
        labels: list[str] = []
        arity: list[int] = []

        def put(items: list) -> int:
            n = 0
            for k, x in enumerate(items):
                if isinstance(x, Group):
                    inner = put(x.items)
                    labels.append(f"Group:{x.sign}")
                    arity.append(inner)
                elif is_sign(x, ",", ";", "."):
                    continue
                else:
                    before = items[k - 1] if k else None
                    literal = x.kind in ("string", "template", "number", "regex")
                    labels.append(f"op:{x.text}" if x.text in OPERATORS and x.kind != "string" else f"Constant:{x.kind}:{x.text[:48]}" if literal else f"Attribute:{x.text}" if is_sign(before, ".", "?.") else x.text if x.text in KEYWORDS or x.kind == "sign" else f"Name:{self.role_of_name(x.text)}")
                    arity.append(0)
                n += 1
            return n

        for s in self.statements:
            inner = put(s)
            labels.append(f"Statement:{self.statement(s).split(':')[0]}")
            arity.append(inner)
        labels.append("body")
        arity.append(len(self.statements))
        return {"label": labels, "arity": arity}

    def detail(self) -> dict:
        kinds = [self.statement(s) for s in self.statements]
        literals = {v for v in self.defaults.values() if v.startswith("CONST_")}
        receivers, uses = set(), {r: set() for r in self.args.values()}
        for c in self.calls:
            roles = [self.role(a) for a in c.args]
            literals.update(r for r in roles if r.startswith("CONST_"))
            name = "_".join(words(c.name))
            if c.receiver:
                root = self.args.get(c.receiver[0]) or ("LOCAL" if c.receiver[0] in self.locals else "CONTEXT")
                path = c.receiver if root == "CONTEXT" else c.receiver[1:]
                receivers.add(".".join([root, *path]))
                if root in uses:
                    uses[root].add(f"receiver_of_calls:{'.'.join([*path, name])}")
            for k, a in enumerate(c.args):
                for r in self.arg_reads(a):
                    uses[r].add(f"passed_as_argument_to:{name}.arg{k}")
        graph, reads, defined = {f"node:argument:{r}" for r in self.args.values()}, [], set()
        for i, (s, label) in enumerate(zip(self.statements, kinds, strict=True)):
            graph.add(f"node:statement:{label}")
            mine = self.arg_reads(s)
            graph.update(f"edge:arg_read:{r}->{label}" for r in mine)
            if i:
                graph.add(f"edge:lexical_order:{kinds[i - 1]}->{label}")
            names = {t.text for t in flat(s) if t.kind == "name"} & self.locals
            graph.update(f"edge:local_flow:{n}->{label}" for n in names & defined)
            defined |= names
            if mine:
                reads.append({"idx": i, "roles": mine})
                if is_sign(s[0], "return"):
                    for r in mine:
                        uses[r].add("returned")
        return {"parameter_default_roles": sorted(f"{k}={v}" for k, v in self.defaults.items()), "graph_features": sorted(graph), "literal_shapes": sorted(literals), "receiver_shapes": sorted(receivers), "parameter_features": {k: sorted(v) for k, v in uses.items()}, "transforms": [], "statement_arg_reads": reads, "tree": self.tree()}


def digest(marks: list[str], size: int) -> str:
    return hashlib.blake2b("\x1f".join(marks).encode("utf-8", "surrogatepass"), digest_size=size).hexdigest()


def roles_of(f: Function, b: Body, file: str, role: str) -> list[str]:
    found = set()
    if f.name == "constructor":
        found.add("constructor")
    if role in ("generated", "vendor", "build_output"):
        found.add("generated_or_cython_boundary")
    if role in ("test", "fixture"):
        found.add("test_code")
    if {p.lower() for p in file.split("/")} & {"demo", "demos", "example", "examples"}:
        found.add("example_code")
    if file.endswith(".d.ts"):
        found |= {"declaration_boundary", "abstract_or_interface_stub"}
    if re.match(r"use[A-Z]", f.name):
        found.add("framework_hook")
    if re.match(r"[A-Z]", f.name) and file.endswith(("x",)):
        found.add("framework_render_surface")
    if not b.statements:
        found |= {"abstract_or_interface_stub", "trivial_body"}
    elif len(b.statements) == 1 and len(list(flat(b.statements[0]))) <= 6:
        found.add("trivial_body")
    return sorted(found) or ["normal_function"]


def extract(file: str, content: bytes, role: str, language: str) -> tuple[list[dict], list[dict], str]:
    """Feature rows and a diagnostic of one file; constants are taken of Python only."""
    text = content.decode("utf-8-sig", "replace")
    try:
        found = functions(grouped(tokens(text)))
    except (SyntaxError, RecursionError) as e:
        return [], [], f"ecmascript_parse_error: {type(e).__name__} (line {getattr(e, 'lineno', None) or 1})"
    lines = text.split("\n")
    rows = []
    for f in sorted(found, key=lambda f: (f.start, f.end)):
        b = Body(f)
        canonical = shape(b.types, b.result)
        rows.append({
            "language": language, "language_family": "ecmascript", "adapter": "ecmascript_tokens", "file": file, "symbol": f.name, "normalized_symbol": " ".join(words(f.name)), "container": ".".join(f.scope), "start_line": f.start, "end_line": f.end, "role": role,
            "type_source": "fallback" if UNKNOWN in (*b.types, b.result) else "declared_syntax", "parameters": b.types, "return_type": b.result, "canonical_shape": canonical, "shape_hash": hashlib.sha256(canonical.encode("utf-8", "surrogatepass")).hexdigest(),
            "body_line_count": f.end - f.start + 1, "body_hash": b.body_hash, "tree_node_count": b.size, "statements": [b.statement(s) for s in b.statements], "statement_keys": b.keys, "statement_spans": [{"start": s, "end": e} for s, e in b.spans],
            "calls": [b.token(c) for c in b.calls], "controls": b.controls, "branch_count": b.branches, "loop_count": b.loops, "return_count": b.returns, "max_nesting": 0, "is_async": f.is_async, "is_public": f.public, "semantic_roles": roles_of(f, b, file, role), "duplicate_blocks": [],
            "source": "\n".join(lines[f.start - 1 : f.end]),
        })
    return rows, [], ""


def detail_of(source: str) -> dict | None:
    """Pair features of a function from its own source lines; none if they don't read alone."""
    for text in (source, f"class _ {{\n{source}\n}}"):
        try:
            if found := functions(grouped(tokens(text))):
                return Body(min(found, key=lambda f: (f.start, -f.end))).detail()
        except (SyntaxError, RecursionError):
            pass
    return None
