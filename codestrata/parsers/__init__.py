"""Parsers by language, and the table function that turns files into units."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from codestrata.parsers import braces, python
from codestrata.parsers.model import Unit, total_lines
from codestrata.schema import UNIT

#: Language to ``parse(source) -> Unit``; further languages are added here.
PARSERS = {lang: partial(braces.parse, lang) for lang in braces.LANGUAGES} | {"python": lambda source: python.parse("", source)}


def parse(lang: str, source: str) -> Unit:
    return PARSERS[lang](source)


def row(path: str, lang: str, class_: str, import_path: str, source: str | None) -> dict:
    source, error = source or "", None
    try:
        unit = parse(lang, source)
    except Exception as problem:  # one broken file is reported with all others, and fails the run there
        unit, error = Unit(lang), f"{path}: {problem!r}"
    functions = [{"ord": i, **vars(f)} for i, f in enumerate(unit.functions)]
    return {
        "path": path, "lang": lang, "class": class_, "package": unit.package, "import_path": import_path, "total_lines": total_lines(source), "physical_sloc": len(unit.code_lines), "logical_loc": unit.logical,
        "comment_lines": unit.comment_lines, "is_generated": unit.generated, "functions": functions, "types": [{"name": n, "abstract": a} for n, a in unit.types], "imports": unit.imports,
        "toks": [t for t, _ in unit.tokens], "tok_lines": [n for _, n in unit.tokens], "error": error,
    }


def parsed(files: DataFrame) -> DataFrame:
    """Units of ``files(path, lang, class, import_path, text)``."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([row(*r) for r in batch[["path", "lang", "class", "import_path", "text"]].itertuples(index=False)], columns=[c.split()[0] for c in _columns()])

    return files.select("path", "lang", "class", "import_path", "text").mapInPandas(run, UNIT)


def _columns() -> list[str]:
    return ["path", "lang", "class", "package", "import_path", "total_lines", "physical_sloc", "logical_loc", "comment_lines", "is_generated", "functions", "types", "imports", "toks", "tok_lines", "error"]
