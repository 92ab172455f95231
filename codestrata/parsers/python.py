"""Python files: structure from the syntax tree, tokens and comments from the tokenizer."""

from __future__ import annotations

import ast
import io
import tokenize

from codestrata.parsers.model import Function, Unit, marked_generated

_LAYOUT = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tokens(source: str, unit: Unit) -> None:
    depth = 0  # of formatted strings, which are one token with all that is in them
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.FSTRING_START:
                if not depth:
                    unit.tokens.append(("STR", t.start[0]))
                depth += 1
            elif t.type == tokenize.FSTRING_END:
                depth -= 1
            elif depth or t.type in _LAYOUT:
                continue
            elif t.type == tokenize.COMMENT:
                unit.comments.append((t.string, t.start[0]))
            else:
                unit.tokens.append(({tokenize.STRING: "STR", tokenize.NUMBER: "NUM"}.get(t.type, t.string), t.start[0]))
    except (tokenize.TokenError, SyntaxError):
        pass  # what was read before the broken place counts


class _Score:
    """Cognitive complexity of one function's body."""

    def __init__(self, function: Function):
        self.f, self.depth = function, 0
        self.own = "" if function.anonymous else function.name

    def nested(self, nodes) -> None:
        self.depth += 1
        self.f.nesting = max(self.f.nesting, self.depth)
        for n in nodes:
            self.visit(n, "")
        self.depth -= 1

    def all(self, nodes, op: str = "") -> None:
        for n in nodes:
            self.visit(n, op)

    def visit(self, n: ast.AST, op: str) -> None:
        if isinstance(n, (*_DEFINITIONS, ast.Lambda)):
            return
        if isinstance(n, ast.If):
            self.f.cognitive += 1 + self.depth
            self.nested(n.body)
            self.visit(n.test, "")
            if n.orelse:
                self.f.cognitive += 1
                if _is_elif(n):
                    # branches after the first elif are not followed
                    self.nested(n.orelse[0].body)
                    self.visit(n.orelse[0].test, "")
                else:
                    self.nested(n.orelse)
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            self._loop(n.body, [n.target, n.iter, *n.orelse])
        elif isinstance(n, ast.While):
            self._loop(n.body, [n.test, *n.orelse])
        elif isinstance(n, ast.Match):
            self._loop(n.cases, [n.subject])
        elif isinstance(n, ast.ExceptHandler):
            self.f.cognitive += 1 + self.depth
            self.all(ast.iter_child_nodes(n))
        elif isinstance(n, ast.IfExp):
            self.f.cognitive += 1 + self.depth
            self.nested([n.test, n.body, n.orelse])
        elif isinstance(n, ast.BoolOp):
            own = type(n.op).__name__
            if own != op:
                self.f.cognitive += 1
                self.f.bool_max = max(self.f.bool_max, _operands(n))
            self.all(n.values, own)
        elif isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
            if name:
                self.f.calls.append(name)
                self.f.cognitive += name == self.own
            self.all(ast.iter_child_nodes(n))
        else:
            self.all(ast.iter_child_nodes(n), op)

    def _loop(self, body, rest) -> None:
        self.f.cognitive += 1 + self.depth
        self.nested(body)
        self.all(rest)


def _operands(n: ast.AST) -> int:
    """Conditions at the leaves; what must stand in parentheses is one."""
    return sum(_operands(v) if isinstance(v, ast.BoolOp) and isinstance(n.op, ast.Or) and isinstance(v.op, ast.And) else 1 for v in n.values)


def _is_elif(n: ast.If) -> bool:
    """Whether the else branch is an if of its own line start, as written with elif."""
    return len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset


class _Walk:
    def __init__(self, unit: Unit):
        self.unit = unit

    def visit(self, n: ast.AST, f: Function | None, of: str, inside: bool, elif_: bool = False) -> None:
        if isinstance(n, ast.ClassDef):
            self.unit.types.append((n.name, False))
            return self.children(n, f, n.name, inside)
        if isinstance(n, (*_DEFINITIONS, ast.Lambda)):
            return self.function(n, f, of, inside)
        if f is not None:
            f.complexity += isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.match_case, ast.IfExp))
            f.complexity += len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0
        if isinstance(n, ast.Import):
            self.unit.imports += [a.name for a in n.names]
        if isinstance(n, ast.ImportFrom) and n.module != "__future__":
            base, first = "." * n.level + (n.module or ""), n.names[0].name
            if n.module:
                self.unit.imports.append(base)
            if first != "*":
                self.unit.imports.append(f"{base}.{first}" if n.module else base + first)
        self.unit.logical += isinstance(n, ast.stmt) and not elif_
        self.children(n, f, of, inside)

    def children(self, n: ast.AST, f: Function | None, of: str, inside: bool) -> None:
        for child in ast.iter_child_nodes(n):
            self.visit(child, f, of, inside, isinstance(n, ast.If) and _is_elif(n) and child is n.orelse[0])

    def function(self, n, outer: Function | None, of: str, inside: bool) -> None:
        anonymous = isinstance(n, ast.Lambda)
        enclosing = (outer.name if outer else of) if anonymous else "" if inside else of
        name = f"<anonymous@{n.lineno}>" if anonymous else n.name
        f = Function(name, n.lineno, n.end_lineno, enclosing, anonymous)
        a = n.args
        names = [x.arg for x in (*a.posonlyargs, *a.args)]
        f.params = len(names) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg) + bool(a.posonlyargs) + bool(a.kwonlyargs and not a.vararg)
        if not anonymous and enclosing and names[:1] and names[0] in ("self", "cls"):
            f.params -= 1
        _Score(f).all([n.body] if anonymous else n.body)
        self.unit.functions.append(f)
        self.children(n, f, of, True)


def parse(path: str, source: str) -> Unit:
    unit = Unit("python")
    _tokens(source, unit)
    unit.generated = marked_generated("python", unit.comments, source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return unit.finish()
    _Walk(unit).children(tree, None, "", False)
    return unit.finish()
