"""Reports as text, JSON, YAML and a Mermaid graph, from frames that are small by then: one row a file at most."""

from __future__ import annotations

import json
import re

from codestrata.operators import gate, smells
from codestrata.plans.analyze import Report

FORMATS = ("text", "json", "yaml", "mermaid")


#: Names of the report's fields where they differ from the columns.
_NAMES = {"avg_cognitive": "avg_cognitive_complexity", "worst_cognitive": "worst_cognitive_complexity", "issues": "issue_count", "cycle_idx": "index", "dup_lines": "duplicated_lines", "cognitive": "cognitive_complexity"}
_FILE_NAMES = _NAMES | {"worst_cognitive": "cognitive_complexity"}


def _named(row: dict, names: dict[str, str] = _NAMES, without: tuple[str, ...] = ()) -> dict:
    return {names.get(k, k): v for k, v in row.items() if k not in without}


def _rows(df, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def collected(r: Report) -> dict:
    """The report as plain values; schema_version 1."""
    verdict, budgets = _rows(r.verdict)[0], _rows(r.budgets, "lang", "key")
    for b in budgets:
        b["label"], b["language"] = gate.METRICS[b["key"]][0], b.pop("lang")
    files = _rows(r.files, "path")
    for f in files:
        for key in ("ca", "ce", "instability", "abstractness", "distance", "cycle", "worst_function", "import_path"):
            if not f[key]:
                del f[key]
    files = [_named(f, _FILE_NAMES) for f in files]
    unshown = ("dup_lines_pct", "worst_function", "cycles", "files_in_cycle")
    out = {
        "schema_version": 1, "tool": "codestrata", "root": r.root, "module_path": r.module, "in_module": bool(r.module), "summary": _named(_rows(r.summary)[0], without=("dup_lines_pct",)), "files": files,
        "cycles": [_named(c) for c in _rows(r.cycles, "cycle_idx")] or None,
        "issues": _rows(smells.ordered(r.issues)), "budgets": budgets, "composite": _rows(r.composite)[0]["score"], "exit_code": verdict["exit_code"],
    }
    if not r.module:
        del out["module_path"]
    out["summary"]["by_language"] = {x.pop("lang"): _named(x, without=unshown) for x in _rows(r.languages, "lang")}
    if r.verbose:
        details: dict[str, list] = {}
        for f in _rows(r.functions, "path", "ord"):
            details.setdefault(f["path"], []).append(_named({k: f[k] for k in ("name", "enclosing", "start_line", "end_line", "complexity", "cognitive", "length", "nesting", "params", "anonymous") if f[k] or k not in ("enclosing", "anonymous")}))
        for f in files:
            if f["class"] == "prod":
                f["functions_detail"] = details.get(f["path"], [])
    return out


def render(r: Report, form: str) -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    if form == "mermaid":
        return mermaid([f["path"] for f in _rows(r.files.filter("class = 'prod'"), "path")], [(e["src"], e["dst"]) for e in _rows(r.edges, "src", "dst")], _rows(r.cycles, "cycle_idx"))
    data = collected(r)
    if form == "json":
        shown = json.dumps(data, indent=2, ensure_ascii=False)
        return shown.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") + "\n"
    if form == "yaml":
        import yaml

        return yaml.safe_dump(data, sort_keys=False, allow_unicode=True).rstrip("\n")
    return text(data)


def number(value: float, digits: int) -> str:
    return f"{value:.{digits}f}" if digits else str(int(value))


def text(d: dict) -> str:
    s, out = d["summary"], []
    title = f"Structure of {d['root']}" + (f"  [module {d['module_path']}]" if d["in_module"] else "")
    out += [title, "─" * len(title), ""]
    out.append(f"Files:  {s['prod_files']} production · {s['test_files']} test · {s['generated_files']} generated skipped · {s['skipped_dirs']} dirs excluded")
    out.append(f"Size:   {s['physical_sloc']} physical SLOC · {s['logical_loc']} logical LOC")
    out.append(f"Types:  {s['types']} ({s['abstract_types']} abstract)")
    if s["functions"]:
        out.append(f"Complexity:  avg {s['avg_complexity']:.2f} / function · worst {s['worst_complexity']} ({s['worst_function']})")
        out.append(f"Cognitive:   avg {s['avg_cognitive_complexity']:.2f} / function · worst {s['worst_cognitive_complexity']}")
        out.append(f"Shape:       longest {s['max_function_length']} lines · max nesting {s['max_nesting']} · max params {s['max_params']}")
    else:
        out.append("Complexity: no functions")
    out.append(f"Comments:    {s['comment_lines']} lines ({s['comment_pct']:.2f}%)")
    out.append(f"Duplication: {s['dup_tokens']} / {s['total_tokens']} tokens ({s['dup_pct']:.2f}%) · {s['dup_blocks']} blocks · {s['duplicated_lines']} lines")
    out.append(f"Cycles:      {s['cycles']} component(s) · {s['files_in_cycle']}/{s['prod_files']} files in cycle ({s['in_cycle_pct']:.2f}%) · largest {s['max_cycle_members']}")
    if d["cycles"]:
        out += ["", "Cyclic dependencies (structural debt):"]
        out += [f"  cycle-{c['index']} ({c['size']} files): {' -> '.join(c['members'])}" for c in d["cycles"]]
    prod = [f for f in d["files"] if f["class"] == "prod"]
    if prod:
        out += ["", "Production files:", f"  {'file':<52} {'SLOC':>7} {'worst':>6} {'dup%':>7} {'cycle':>6}"]
        out += [f"  {f['path']:<52} {f['physical_sloc']:>7} {f['worst_complexity']:>6} {f['dup_pct']:>6.2f}% {'y' if f['in_cycle'] else '':>6}" for f in prod]
    if d["issues"]:
        out += ["", f"Structural smells ({len(d['issues'])}):", f"  {'severity':<9} {'rule':<22} {'location':<40} value/threshold"]
        for i in d["issues"]:
            place = f"{i['file']}:{i['line']}" + (f" {i['function']}" if i["function"] else "")
            out.append(f"  {i['severity']:<9} {i['rule']:<22} {place:<40} {i['value']:.2f} / {i['threshold']:.2f}")
    flagged = {(i["file"], i["function"]) for i in d["issues"] if i["function"]}
    detail = [(f["path"], x) for f in d["files"] for x in f.get("functions_detail", []) if (f["path"], x["name"]) in flagged]
    if detail:
        out += ["", "Flagged functions:", f"  {'function':<40} {'cyclo':>6} {'cogn':>6} {'lines':>6} {'nest':>6}"]
        out += [f"  {p + ': ' + x['name']:<40} {x['complexity']:>6} {x['cognitive_complexity']:>6} {x['length']:>6} {x['nesting']:>6}" for p, x in detail]
    out += ["", "Quality gate (budgets):"]
    for b in d["budgets"]:
        digits = gate.METRICS[b["key"]][2]
        key = f"{b['language']}/{b['key']}" if b["language"] else b["key"]
        tier = b["tier"] or "Warn"
        out.append(f"  [{tier:<5}] {key:<26} {number(b['value'], digits):>12} / {number(b['limit'], digits):<10}  {'BREACHED' if b['breached'] else 'ok'}")
    if not d["budgets"]:
        out.append("  (none configured)")
    words = {gate.PASS: "pass", gate.BREACH: "budget breach", gate.USAGE: "usage error", gate.INTERNAL: "internal error"}
    out += ["", f"Composite index: {d['composite']:.1f} / 100", f"Exit code: {d['exit_code']} ({words[d['exit_code']]})"]
    return "\n".join(out) + "\n"


def node_id(path: str) -> str:
    return "f_" + re.sub(r"[^A-Za-z0-9_]", "_", path)


def short(path: str) -> str:
    parts = path.split("/")
    return path if len(parts) < 3 else "/".join(parts[-2:])


def mermaid(paths: list[str], edges: list[tuple[str, str]], cycles: list[dict]) -> str:
    """A flowchart with a subgraph for each cycle, where its first member stands, then the other files, then the edges."""
    held = {m: c for c in cycles for m in c["members"]}
    out, drawn = ["flowchart LR"], set()
    every = sorted({*paths, *[p for e in edges for p in e]})
    for p in every:
        c = held.get(p)
        if c and c["cycle_idx"] not in drawn:
            drawn.add(c["cycle_idx"])
            n = c["cycle_idx"]
            out.append(f'  subgraph cycle{n}["cycle-{n} · {c["size"]} files"]')
            out += [f'    {node_id(m)}["{short(m)}"]' for m in c["members"]]
            out.append("  end")
    out += [f'  {node_id(p)}["{short(p)}"]' for p in every if p not in held]
    out += [f"  {node_id(a)} --> {node_id(b)}" for a, b in edges if a != b]
    return "\n".join(out) + "\n"
