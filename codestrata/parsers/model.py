"""What a parser makes of one file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SIGNIFICANT = re.compile(r"[^\W_]")


@dataclass
class Function:
    name: str
    start_line: int
    end_line: int
    enclosing: str = ""
    anonymous: bool = False
    params: int = 0
    complexity: int = 1
    cognitive: int = 0
    nesting: int = 0
    bool_max: int = 0
    length: int = 0
    calls: list[str] = field(default_factory=list)


@dataclass
class Unit:
    """``tokens``: (text, line), names and marks as they are, literals as STR, NUM or CHAR; ``comments``: (text, line)."""

    lang: str
    tokens: list[tuple[str, int]] = field(default_factory=list)
    comments: list[tuple[str, int]] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    types: list[tuple[str, bool]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    package: str = ""
    logical: int = 0
    code_lines: set[int] = field(default_factory=set)
    generated: bool = False

    def finish(self) -> Unit:
        self.code_lines |= {line for _, line in self.tokens}
        for f in self.functions:
            f.length = sum(f.start_line <= line <= f.end_line for line in self.code_lines)
        return self

    @property
    def comment_lines(self) -> int:
        return len({line + i for text, line in self.comments for i, part in enumerate(text.split("\n")) if _SIGNIFICANT.search(part)})


def total_lines(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def marked_generated(lang: str, comments: list[tuple[str, int]], source: str) -> bool:
    for text, _ in comments:
        both = "Code generated" in text and "DO NOT EDIT" in text
        if lang == "go":
            both = both and text.startswith("// Code generated")
        if both or lang in ("java", "rust") and ("@generated" in text or "<auto-generated>" in text.lower()):
            return True
    return lang == "java" and bool(re.search(r"@(?:\w+\.)*Generated\b", source))
