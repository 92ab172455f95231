"""Languages with braces (Go, TypeScript, JavaScript, C, C++, Java, Rust) by one lexer and one structural walk over bracket pairs.

The walk follows control keywords, functions, types and logical operators; it does not build a full syntax tree. Counts of statements
and of tokens can differ from a grammar's in rare constructs; decisions, nesting and function shapes are those of the language's rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codestrata.parsers.model import Function, Unit, marked_generated


@dataclass(frozen=True)
class Language:
    name: str
    parens: bool  # conditions stand in parentheses
    case_counts: frozenset[str]  # labels that are decisions
    ternary: bool
    chars: str  # what a character literal becomes
    groups_pass: bool = True  # an operator's sequence goes on inside parentheses


_F = frozenset
LANGUAGES = {
    "go": Language("go", False, _F({"case", "default"}), False, "CHAR", False),
    "typescript": Language("typescript", True, _F({"case", "default"}), True, "STR"),
    "javascript": Language("javascript", True, _F({"case", "default"}), True, "STR"),
    "c": Language("c", True, _F({"case", "default"}), True, "STR"),
    "cpp": Language("cpp", True, _F({"case", "default"}), True, "STR"),
    "java": Language("java", True, _F({"case"}), True, "STR"),
    "rust": Language("rust", False, _F(), False, "STR"),
}
#: Words that are never the name of a function or call.
CONTROL = _F("if for while switch do else case default return catch try finally throw new delete typeof sizeof void in of instanceof match loop select go defer range func fn function synchronized await yield super class struct interface enum".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MARKS = r">>>=|\.\.\.|<<=|>>=|===|!==|\*\*=|&&=|\|\|=|\?\?=|&\^=|->|=>|::|:=|<-|&&|\|\||\?\?|\?\.|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\.\.|[^\s\w]"
_NAME = r"[^\W\d][\w$]*|[$@#][\w$]+"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+)\w*"


def _lexer(lang: str) -> re.Pattern:
    text = r'"(?:\\.|[^"\\\n])*"?'
    char = r"'(?:\\.|[^'\\\n])*'?"
    parts = [r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"]
    if lang == "rust":
        text = r'b?r(?P<hash>#*)"[\s\S]*?"(?P=hash)|b?"(?:\\[\s\S]|[^"\\])*"?'
        char = r"b?'(?:\\[^']+|[^'\\])'"
        parts.append(f"(?P<string>{text})|(?P<char>{char})|(?P<life>'\\w+)")
    elif lang == "go":
        parts.append(rf"(?P<string>`[^`]*`?|{text})|(?P<char>{char})")
    elif lang in ("typescript", "javascript"):
        parts.append(rf"(?P<string>`(?:\\[\s\S]|[^`\\])*`?|{text}|{char})")
    elif lang == "java":
        parts.append(rf'(?P<string>"""[\s\S]*?(?:"""|\Z)|{text})|(?P<char>{char})')
    else:
        parts.append(rf'(?P<include>(?m:^[ \t]*)#[ \t]*include[ \t]*(?:<[^>\n]*>|"[^"\n]*"))|(?P<string>(?:R"\([\s\S]*?\)"|[LuU]?8?{text}))|(?P<char>{char})')
    parts.append(rf"(?P<number>{_NUMBER})|(?P<name>{_NAME})|(?P<mark>{_MARKS})|(?P<line>\n)|(?P<space>[^\S\n]+)")
    return re.compile("|".join(parts))


_LEXERS = {lang: _lexer(lang) for lang in LANGUAGES}
_BEFORE_REGEX = _F("( , = : [ ! & | ? { } ; => && || return typeof case in of".split())
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


class Walk:
    def __init__(self, lang: str, source: str):
        self.lang, self.spec, self.unit = lang, LANGUAGES[lang], Unit(lang)
        self.t: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.ends_line: list[bool] = []
        self._lex(source)
        self.pair = self._pairs()
        self.silent: set[int] = set()  # tokens of type declarations that are not emitted

    def _lex(self, source: str) -> None:
        lexer, at, line = _LEXERS[self.lang], 0, 1
        while at < len(source):
            m = None
            if source[at] == "/" and self.lang in ("typescript", "javascript") and (not self.t or self.t[-1] in _BEFORE_REGEX):
                m = _REGEX.match(source, at)
            kind = "regex" if m else ""
            m = m or lexer.match(source, at)
            if not m:
                at += 1
                continue
            kind = kind or m.lastgroup
            kind = "string" if kind == "hash" else kind
            text = m[0]
            if kind == "line" and self.ends_line:
                self.ends_line[-1] = True
            if kind == "comment":
                self.unit.comments.append((text, line))
            elif kind == "include":
                inner = re.search(r'<[^>]*>|"[^"]*"', text)[0]
                self.unit.imports.append(inner if inner[0] == "<" else inner[1:-1])
                for piece in ("#include", "STR"):
                    self._push("name" if piece != "STR" else "string", piece, line + text.count("\n"))
                self.ends_line[-1] = True
            elif kind not in ("line", "space"):
                self._push(kind, text, line)
            line += text.count("\n")
            at = m.end()

    def _push(self, kind: str, text: str, line: int) -> None:
        self.kind.append(kind), self.t.append(text), self.line.append(line), self.ends_line.append(False)

    def _pairs(self) -> dict[int, int]:
        out, open_ = {}, []
        for i, (text, kind) in enumerate(zip(self.t, self.kind, strict=True)):
            if kind != "mark":
                continue
            if text in _OPEN:
                open_.append(i)
            elif text in _CLOSE:
                while open_ and _OPEN[self.t[open_[-1]]] != text:
                    open_.pop()
                if open_:
                    j = open_.pop()
                    out[i], out[j] = j, i
        return out

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) and self.kind[i] not in ("string", "char", "regex") else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.kind[i] == "name" and self.t[i] not in CONTROL

    def close(self, i: int) -> int:
        return self.pair.get(i, len(self.t) - 1)

    def skip_angles(self, i: int) -> int:
        """Past generic arguments that start at i."""
        depth = 0
        while i < len(self.t):
            depth += (self.at(i) == "<") - (self.at(i) == ">") - 2 * (self.at(i) == ">>")
            if self.at(i) in (";", "{"):
                return i
            i += 1
            if depth <= 0:
                return i
        return i

    # functions

    def function_at(self, i: int, top: bool) -> tuple | None:
        """(name, enclosing or None, first and last token of the parameters, first and past-last token of the body, anonymous) of a function that starts at i."""
        return {"go": self._go, "rust": self._rust, "java": self._java, "c": self._c, "cpp": self._c}.get(self.lang, self._script)(i, top)

    def _body_after(self, i: int, stop: frozenset[str] = _F({";", "="})) -> int | None:
        """The brace that opens a body after a signature."""
        while i < len(self.t):
            text = self.at(i)
            if text == "{":
                return i
            if text in stop or text in _CLOSE:
                return None
            if text in ("interface", "struct") and self.at(i + 1) == "{":
                i = self.close(i + 1)
            elif text in ("(", "["):
                i = self.close(i)
            i += 1
        return None

    def _go(self, i: int, top: bool):
        if self.at(i) != "func":
            return None
        j, enclosing, name = i + 1, None, ""
        if top and self.at(j) == "(" and self.is_name(self.close(j) + 1) and self.at(self.close(j) + 2) in ("(", "["):
            names = [self.t[k] for k in range(j + 1, self.close(j)) if self.kind[k] == "name"]
            enclosing, j = (names[1] if len(names) > 1 else names[0]) if names else "", self.close(j) + 1
        if self.is_name(j):
            name, j = self.t[j], j + 1
            if self.at(j) == "[":
                j = self.close(j) + 1
        if self.at(j) != "(":
            return None
        p, k = j, self.close(j) + 1
        while k < len(self.t) and self.at(k) != "{":
            if self.at(k) in ("interface", "struct") and self.at(k + 1) == "{":
                k = self.close(k + 1)
            elif self.at(k) in ("(", "["):
                k = self.close(k)
            elif self.at(k) in _CLOSE or self.at(k) in (",", ";", "=", ":="):
                return None
            if self.ends_line[k]:
                return None
            k += 1
        if self.at(k) != "{" or self.ends_line[k - 1] and k - 1 > self.close(p):
            return None
        return name, enclosing, p, self.close(p), k, self.close(k), not name

    def _rust(self, i: int, top: bool):
        if self.at(i) == "fn" and self.is_name(i + 1):
            j = i + 2
            if self.at(j) == "<":
                j = self.skip_angles(j)
            if self.at(j) != "(":
                return None
            k = self._body_after(self.close(j) + 1, _F({";"}))
            return None if k is None else (self.t[i + 1], None, j, self.close(j), k, self.close(k), False)
        if self.at(i) in ("|", "||") and (self.at(i - 1) in ("(", ",", "=", "=>", "{", ";", "return", "move", ":", "}") or i == 0):
            j = i
            if self.at(i) == "|":
                j = i + 1
                while j < len(self.t) and self.at(j) != "|":
                    j = self.close(j) + 1 if self.at(j) in _OPEN else j + 1
            k = j + 1
            if self.at(k) == "->":
                k = self._body_after(k) or k
            end = self.close(k) if self.at(k) == "{" else self._expression_end(k)
            return "", None, i, j, k, end, True
        return None

    def _expression_end(self, i: int) -> int:
        """The last token of an expression body that starts at i, by brackets, commas, semicolons and, without these, the line."""
        while i < len(self.t):
            if self.at(i) in _OPEN:
                i = self.close(i)
            if self.at(i + 1) in (",", ";") or self.at(i + 1) in _CLOSE or i + 1 >= len(self.t) or self.ends_line[i] and self.at(i + 1) not in (".", "?", ":", "&&", "||", "+"):
                return i
            i += 1
        return len(self.t) - 1

    def _script(self, i: int, top: bool):
        text = self.at(i)
        if text == "function":
            j = i + 1 + (self.at(i + 1) == "*")
            name = ""
            if self.is_name(j):
                name, j = self.t[j], j + 1
            if self.at(j) == "<":
                j = self.skip_angles(j)
            k = self._body_after(self.close(j) + 1) if self.at(j) == "(" else None
            return None if k is None else (name, None, j, self.close(j), k, self.close(k), not name)
        arrow = i + 1 if self.is_name(i) and self.at(i + 1) == "=>" else None
        if text == "(":
            k = self.close(i) + 1
            if self.at(k) == ":":
                while k < len(self.t) and self.at(k) not in ("=>", ";", "{", ")", ","):
                    k = self.close(k) + 1 if self.at(k) in ("(", "[", "{") else k + 1
            arrow = k if self.at(k) == "=>" else None
        if arrow is not None:
            k = arrow + 1
            end = self.close(k) if self.at(k) == "{" else self._expression_end(k)
            p = i if text == "(" else arrow
            return "", "", p, self.close(i) if text == "(" else arrow, k, end, True
        if self.is_name(i) and self.at(i - 1) not in (".", "new", "?.") and (self.at(i + 1) == "(" or self.at(i + 1) == "<"):
            j = i + 1 if self.at(i + 1) == "(" else self.skip_angles(i + 1)
            if self.at(j) != "(":
                return None
            k = self.close(j) + 1
            if self.at(k) == ":":
                k += 1
                while k < len(self.t) and self.at(k) not in ("{", ";", ",", ")", "}", "="):
                    k = self.close(k) + 1 if self.at(k) in ("(", "[") else self.skip_angles(k) if self.at(k) == "<" else k + 1
            if self.at(k) == "{":
                return self.t[i], None, j, self.close(j), k, self.close(k), False
        return None

    def _java(self, i: int, top: bool):
        text = self.at(i)
        if text == "(" and self.at(self.close(i) + 1) == "->" or self.is_name(i) and self.at(i + 1) == "->":
            p, e = (i, self.close(i)) if text == "(" else (i + 1, i + 1)
            k = (self.close(i) if text == "(" else i) + 2
            if self.at(i - 1) in ("case", ",") and text != "(":
                return None
            return "", None, p, e, k, self.close(k) if self.at(k) == "{" else self._expression_end(k), True
        if top and self.is_name(i) and self.at(i + 1) == "(" and self.at(i - 1) not in (".", "new", "@"):
            k = self.close(i + 1) + 1
            while k < len(self.t) and (self.at(k) in ("throws", ",", ".", "@") or self.is_name(k)):
                k += 1
            if self.at(k) == "{":
                return self.t[i], None, i + 1, self.close(i + 1), k, self.close(k), False
        return None

    def _c(self, i: int, top: bool):
        if self.lang == "cpp" and self.at(i) == "[" and (not self.is_name(i - 1) and self.at(i - 1) not in (")", "]")):
            j = self.close(i) + 1
            p = j if self.at(j) == "(" else None
            k = self._body_after(self.close(j) + 1 if p is not None else j)
            if k is not None and (p is not None or k == j):
                return "", None, p if p is not None else j, self.close(p) if p is not None else j, k, self.close(k), True
        if top and self.is_name(i) and self.at(i + 1) == "(":
            k = self.close(i + 1) + 1
            stop = _F({";", "=", ","})
            while k < len(self.t) and self.at(k) != "{":
                if self.at(k) in stop or self.at(k) in _CLOSE:
                    return None
                if self.at(k) == ":":  # constructor initialisers
                    stop = _F({";"})
                    if self.at(k + 2) == "{" and self.at(self.close(k + 2) + 1) in (",", "{"):
                        k = self.close(k + 2)
                elif self.at(k) in ("(", "["):
                    k = self.close(k)
                k += 1
            if self.at(k) == "{":
                owner = self.t[i - 2] if self.at(i - 1) == "::" and self.is_name(i - 2) else None
                return self.t[i], owner, i + 1, self.close(i + 1), k, self.close(k), False
        return None

    def parameters(self, first: int, last: int) -> int:
        if self.at(first) not in ("(", "|"):
            return 0
        parts, start, i = [], first + 1, first + 1
        angle = 0
        while i < last:
            text = self.at(i)
            if text in _OPEN:
                i = self.close(i)
            elif self.lang != "go" and text in ("<", ">"):
                angle = max(0, angle + (1 if text == "<" else -1))
            elif text == "," and not angle:
                parts.append((start, i))
                start = i + 1
            i += 1
        if start < last:
            parts.append((start, last))
        if self.lang in ("c", "cpp") and len(parts) == 1 and self.t[parts[0][0] : parts[0][1]] == ["void"]:
            return 0
        if self.lang == "rust":
            parts = [p for p in parts if "self" not in self.t[p[0] : p[1]][:4] or ":" in self.t[p[0] : p[1]][:2]]
        return len(parts)

    # types

    def type_at(self, i: int) -> tuple[str, bool, int, int] | None:
        """(name, abstract, first body token, last body token) of a type declared at i; a body of (i, i) where there is none."""
        text = self.at(i)
        lang = self.lang
        if lang == "go":
            if text == "type" and self.is_name(i + 1):
                k = i + 2
                if self.at(k) == "[":
                    k = self.close(k) + 1
                body = k + 1 if self.at(k) in ("struct", "interface") and self.at(k + 1) == "{" else None
                end = self.close(body) if body else i + 1
                return self.t[i + 1], self.at(k) == "interface" and bool(body) and end > body + 1, end, end
            return None
        words = {"java": ("class", "interface", "enum", "record", "@interface"), "rust": ("struct", "enum", "trait", "union"), "cpp": ("class", "struct"), "c": ()}.get(lang, ("class", "interface", "enum", "type"))
        if text not in words or not self.is_name(i + 1) or self.at(i - 1) in (".", "enum"):
            return None
        if text in ("type", "record", "union") and self.at(i + 2) not in ("=", "<", "(", "{"):
            return None
        if lang == "cpp":
            k = i + 2
            while k < len(self.t) and self.at(k) not in ("{", ";", "(", ")", ",", "=", ">"):
                k += 1
            if self.at(k) != "{":
                return None
            pure = any(self.t[j + 1 : j + 4] == ["=", "0", ";"] and self.t[j] in (")", "const", "noexcept", "override") for j in range(k, self.close(k)))
            return self.t[i + 1], pure, k, self.close(k)
        k = self._body_after(i + 2, _F({";"})) if text != "type" else None
        before = self.t[max(0, i - 6) : i]
        abstract = text in ("interface", "@interface", "trait") or "abstract" in before and not set(before) & {";", "}"} or "abstract" in before[-2:]
        return (self.t[i + 1], abstract, k, self.close(k)) if k is not None else (self.t[i + 1], abstract, i + 1, i + 1)

    def owner_at(self, i: int) -> tuple[str, int, int] | None:
        """(type, first body token, last body token) of a Rust impl."""
        if self.lang != "rust" or self.at(i) != "impl":
            return None
        k = self._body_after(i + 1, _F({";"}))
        if k is None:
            return None
        j = self.skip_angles(i + 1) if self.at(i + 1) == "<" else i + 1
        names = []
        while j < k and self.at(j) != "where":
            if self.at(j) == "for":
                names = []
            elif self.at(j) == "<":
                j = self.skip_angles(j) - 1
            elif self.is_name(j):
                names.append(self.t[j])
            j += 1
        return (names[-1] if names else ""), k, self.close(k)

    # walks

    def outer(self, lo: int, hi: int, owner: str) -> None:
        """Declarations in [lo, hi)."""
        i = lo
        while i < hi:
            if found := self.owner_at(i):
                self.outer(found[1] + 1, found[2], found[0])
                i = found[2] + 1
                continue
            if found := self.type_at(i):
                name, abstract, first, last = found
                self.unit.types.append((name, abstract))
                if self.lang != "go":
                    self.silent |= {i, i + 1} | ({first, last} if first != last else set())
                if first < last:
                    self.outer(first + 1, last, name)
                i = max(last, i) + 1
                continue
            if found := self.function_at(i, True):
                i = self.function(found, i, owner, None) + 1
                continue
            self.imported(i)
            i += 1

    def imported(self, i: int) -> None:
        text, out = self.at(i), self.unit.imports
        if self.lang == "go" and text == "import":
            inner = range(i + 2, self.close(i + 1)) if self.at(i + 1) == "(" else range(i + 1, min(i + 3, len(self.t)))
            out += [self.t[k][1:-1] for k in inner if self.kind[k] == "string"]
        elif self.lang in ("typescript", "javascript") and text in ("import", "export") and self.at(i + 1) != "(":
            k, last = i + 1, None
            while k < len(self.t) and self.at(k) not in (";", "=", "function", "class", "const", "let", "var", "interface", "default", "enum", "type", "abstract", "async") and not (last is not None):
                if self.kind[k] == "string":
                    last = k
                k = self.close(k) if self.at(k) == "{" else k
                k += 1
            if last is not None:
                out.append(self.t[last][1:-1])
        elif self.lang == "java" and text in ("import", "package"):
            k = i + 1
            words = []
            while k < len(self.t) and self.at(k) != ";":
                if self.t[k] != "static":
                    words.append(self.t[k])
                k += 1
            if text == "import":
                out.append("".join(words))
            else:
                self.unit.package = "".join(words)
        elif self.lang == "go" and text == "package" and self.is_name(i + 1) and not self.unit.package:
            self.unit.package = self.t[i + 1]
        elif self.lang == "rust" and text == "use":
            k = i + 1
            while k < len(self.t) and self.at(k) != ";":
                k += 1
            out.append("".join(f" {x} " if x == "as" else x for x in self.t[i + 1 : k]))
        elif self.lang == "rust" and text == "mod" and self.is_name(i + 1) and self.at(i + 2) == ";":
            out.append(f"mod:{self.t[i + 1]}")
        elif self.lang == "rust" and text == "extern" and self.at(i + 1) == "crate":
            out.append(f"extern:{self.t[i + 2]}")

    def function(self, found: tuple, i: int, owner: str, outer: Function | None) -> int:
        """Score the function found at token i; returns its last token."""
        name, enclosing, p, pe, lo, hi, anonymous = found
        line = self.line[i]
        if anonymous:
            name = f"<anonymous@{line}>"
            enclosing = "" if enclosing == "" else (outer.name if outer else "") if self.lang == "go" else owner
        elif enclosing is None:
            enclosing = owner if outer is None or self.lang in ("java", "c", "cpp") else ""
        if self.lang in ("java", "c", "cpp", "typescript", "javascript") and not anonymous:
            while i > 0 and self.line[i - 1] <= self.line[i] and (self.is_name(i - 1) or self.at(i - 1) in ("*", "&", "::", ">", "<", "]", "[", "~", "void")):
                i -= 1
            line = self.line[i]
        f = Function(name, line, self.line[min(hi, len(self.t) - 1)], enclosing, anonymous, self.parameters(p, pe))
        self.unit.functions.append(f)
        body = (lo + 1, hi) if self.at(lo) == "{" else (lo, hi + 1)
        _Body(self, f, owner).scan(*body, 0, "")
        return hi

    def emit(self) -> None:
        short = {"string": "STR", "number": "NUM", "regex": "NUM", "char": self.spec.chars}
        self.unit.tokens = [(short.get(k, t), n) for i, (t, k, n) in enumerate(zip(self.t, self.kind, self.line, strict=True)) if i not in self.silent]


class _Body:
    """Decisions, cognitive score, nesting and calls of one function."""

    def __init__(self, walk: Walk, f: Function, owner: str):
        self.w, self.f, self.owner = walk, f, owner
        self.arms = 0

    def nested(self, lo: int, hi: int, depth: int) -> None:
        self.f.nesting = max(self.f.nesting, depth + 1)
        self.scan(lo, hi, depth + 1, "")

    def statement(self, i: int, hi: int, depth: int) -> int:
        """A nested block or single statement at i; returns the token after it."""
        w = self.w
        if w.at(i) == "{":
            end = w.close(i)
            self.nested(i + 1, end, depth)
            return end + 1
        end = i
        if w.at(i) in ("if", "for", "while", "switch", "do", "try"):
            self.f.nesting = max(self.f.nesting, depth + 1)
            return self.control(i, hi, depth + 1)
        while end < hi and w.at(end) != ";":
            end = w.close(end) + 1 if w.at(end) in _OPEN else end + 1
        self.nested(i, end, depth)
        return end + 1

    def head(self, i: int, hi: int) -> tuple[int, int, int]:
        """(first, past-last token of a header after the keyword at i, the token after it)."""
        w = self.w
        if w.spec.parens:
            j = i + 1
            while j < hi and w.at(j) != "(" and w.at(j) not in ("{", ";"):
                j += 1
            if w.at(j) != "(":
                return j, j, j
            return j + 1, w.close(j), w.close(j) + 1
        j = i + 1
        while j < hi and w.at(j) != "{":
            if inner := w.function_at(j, False):
                j = inner[5] + 1
            else:
                j = w.close(j) + 1 if w.at(j) in ("(", "[") else j + 1
        return i + 1, j, j

    def control(self, i: int, hi: int, depth: int) -> int:
        w, f, word = self.w, self.f, self.w.at(i)
        w.unit.logical += 1
        if word == "if":
            lo, end, after = self.head(i, hi)
            f.complexity += 1
            f.cognitive += 1 + depth
            self.scan(lo, end, depth, "")
            after = self.statement(after, hi, depth)
            while w.at(after) == "else":
                f.cognitive += 1
                if w.at(after + 1) != "if":
                    return self.statement(after + 1, hi, depth)
                w.unit.logical += 1
                f.complexity += 1
                lo, end, after = self.head(after + 1, hi)
                self.scan(lo, end, depth, "")
                after = self.statement(after, hi, depth)
            return after
        if word in ("for", "while", "loop"):
            lo, end, after = self.head(i, hi) if word != "loop" else (i + 1, i + 1, i + 1)
            f.complexity += 1
            f.cognitive += 1 + depth
            self.scan(lo, end, depth, "")
            return self.statement(after, hi, depth)
        if word in ("switch", "select", "match"):
            lo, end, after = self.head(i, hi) if word != "select" else (i + 1, i + 1, i + 1)
            f.cognitive += 1 + depth
            self.scan(lo, end, depth, "")
            if w.lang == "rust" and w.at(after) == "{":
                f.complexity += max(0, self._arms(after) - 1)
            return self.statement(after, hi, depth)
        if word == "do":
            f.complexity += 1
            f.cognitive += 1 + depth
            after = self.statement(i + 1, hi, depth)
            if w.at(after) == "while":
                lo, end, after = self.head(after, hi)
                self.scan(lo, end, depth, "")
            return after
        # catch
        lo, end, after = self.head(i, hi)
        f.complexity += 1
        f.cognitive += 1 + depth
        return self.statement(after, hi, depth)

    def _guard(self, i: int, hi: int) -> bool:
        """Whether an ``if`` belongs to the pattern of a match arm."""
        w = self.w
        if w.lang != "rust" or w.at(i) != "if":
            return False
        while i < hi and w.at(i) not in ("{", ";", "=>"):
            i = w.close(i) + 1 if w.at(i) in ("(", "[") else i + 1
        return w.at(i) == "=>"

    def _arms(self, brace: int) -> int:
        w, n, i = self.w, 0, brace + 1
        while i < w.close(brace):
            n += w.at(i) == "=>"
            i = w.close(i) + 1 if w.at(i) in _OPEN else i + 1
        return n

    def scan(self, lo: int, hi: int, depth: int, inherited: str) -> None:
        """Tokens of one bracket level: control statements, functions, calls, and segments of logical operators."""
        w, f, spec = self.w, self.f, self.w.spec
        ops: list[str] = []
        groups: list[tuple[int, int, int]] = []
        lift = 0  # operands of a conditional expression are nested
        words = ("if", "for", "while", "switch", "do", "catch") if spec.parens else ("if", "for", "switch", "select") if w.lang == "go" else ("if", "while", "loop", "for", "match")

        def flush() -> None:
            nonlocal ops, groups, lift
            if ops:
                self._sequences(ops, inherited)
            for slot, a, b in groups:
                near = ops[max(0, slot - 1) : slot + 1]
                op = "&&" if "&&" in near else "||" if ops else inherited
                self.scan(a, b, depth + lift, op if spec.groups_pass else "")
            ops, groups, lift = [], [], 0

        i, statement = lo, True
        while i < hi:
            text = w.at(i)
            if found := w.function_at(i, False):
                i = w.function(found, i, self.owner, f) + 1
                continue
            if text in words and w.at(i - 1) not in (".", "::") and not self._guard(i, hi) and not (text == "for" and w.lang == "rust" and w.at(i + 1) == "<"):
                flush()
                i = self.control(i, hi, depth + lift)
                statement = True
                continue
            if text in spec.case_counts and w.at(i - 1) not in (".",) and (text != "default" or w.at(i + 1) in (":", "->")):
                f.complexity += 1
            if text in ("&&", "||") and not (w.lang == "rust" and w.at(i - 1) in ("(", ",", "=")):
                ops.append(text)
                f.complexity += 1
            elif text == "?" and w.lang == "rust":
                f.complexity += 1
                f.cognitive += 1
            elif text == "?" and spec.ternary and w.at(i + 1) not in (":", ",", ")", ";", "="):
                f.complexity += 1
                f.cognitive += 1 + depth + lift
                found_ops, found_groups, now = ops, groups, lift
                if found_ops:
                    self._sequences(found_ops, inherited)
                for slot, a, b in found_groups:
                    near = found_ops[max(0, slot - 1) : slot + 1]
                    self.scan(a, b, depth + now, "&&" if "&&" in near else "||" if found_ops else inherited)
                ops, groups, lift = [], [], now + 1
                f.nesting = max(f.nesting, depth + lift)
            elif text == "goto" and w.lang in ("c", "cpp") or text in ("break", "continue") and w.lang == "go" and w.is_name(i + 1) and not w.ends_line[i]:
                f.cognitive += 1
            elif text in ("{", ";", "}", ",", "=", ":=", "return", "=>", ":") and not (text == ":" and lift):
                flush()
                if text in (";",) or w.lang == "go" and w.ends_line[i]:
                    statement = True
            if text == "(":
                end = w.close(i)
                if w.is_name(i - 1) or w.at(i - 1) in (")", "]", ">") or w.at(i - 1) in ("super", "this"):
                    if w.is_name(i - 1) and w.at(i - 2) not in ("new", "func", "fn"):
                        f.calls.append(w.t[i - 1])
                        if not f.anonymous and w.t[i - 1] == f.name:
                            f.cognitive += 1
                    self.scan(i + 1, end, depth + lift, "")
                else:
                    groups.append((len(ops), i + 1, end))
                i = end
            elif text == "[":
                self.scan(i + 1, w.close(i), depth + lift, "")
                i = w.close(i)
            elif text == "{":
                self.scan(i + 1, w.close(i), depth + lift, "")
                i = w.close(i)
                statement = True
            if statement and text and text not in (";", "{", "}", ")") and text not in spec.case_counts:
                w.unit.logical += 1
                statement = False
            if w.lang == "go" and w.ends_line[i] and w.at(i) not in ("&&", "||", ",", "(", "{", "."):
                flush()
                statement = True
            i += 1
        flush()

    def _sequences(self, ops: list[str], inherited: str) -> None:
        f = self.f
        runs = sum(op == "&&" and (k == 0 or ops[k - 1] == "||") for k, op in enumerate(ops))
        mixed = "||" in ops
        new = (mixed and inherited != "||") + (runs if mixed or inherited != "&&" else 0)
        f.cognitive += new
        if new:
            f.bool_max = max(f.bool_max, len(ops) + 1)


def parse(lang: str, source: str) -> Unit:
    walk = Walk(lang, source)
    walk.outer(0, len(walk.t), "")
    walk.emit()
    walk.unit.generated = marked_generated(lang, walk.unit.comments, source)
    return walk.unit.finish()
