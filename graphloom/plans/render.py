"""JSON and Markdown of query results: bounded pages of rows, put together in the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detail import MOST_LISTED

DISCLAIMER = "Source as indexed; read the file again before editing if it may have changed."


def number(n: int) -> str:
    return f"{n:,}"


def megabytes(n: int) -> str:
    return f"{n / 1024 / 1024:.2f} MB"


def plural(n: int, word: str) -> str:
    return word if n == 1 else word + "s"


def dump(value) -> str:
    """JSON with the escapes of HTML-safe encoders."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


# ---- JSON -----------------------------------------------------------------------------------------------------------


def node_json(row: dict) -> dict:
    """One node of a query result: empty signature, docstring and return type are left out, empty visibility is null."""
    out = {
        "id": row["id"], "kind": row["kind"], "name": row["name"], "qualifiedName": row["qualified_name"],
        "filePath": row["file_path"], "language": row["language"], "startLine": row["start_line"], "endLine": row["end_line"],
        "startColumn": row["start_col"], "endColumn": row["end_col"],
    }
    out |= {k: row[c] for k, c in (("signature", "signature"), ("docstring", "docstring")) if row[c]}
    out |= {"visibility": row["visibility"] or None, "isExported": row["is_exported"]}
    out |= {"returnType": row["return_type"]} if row["return_type"] else {}
    return out | {"isAsync": False, "isStatic": False, "isAbstract": False}


def query_json(found: DataFrame) -> str:
    return dump([{"node": node_json(r.asDict())} for r in found.collect()])


def query_json_column() -> Column:
    """The same envelope as a column, for results that stay distributed."""
    drop = lambda c: F.nullif(F.col(c), F.lit(""))
    body = F.struct(
        "id", "kind", "name", F.col("qualified_name").alias("qualifiedName"), F.col("file_path").alias("filePath"), "language",
        F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("start_col").alias("startColumn"),
        F.col("end_col").alias("endColumn"), drop("signature").alias("signature"), drop("docstring").alias("docstring"),
        drop("visibility").alias("visibility"), F.col("is_exported").alias("isExported"), drop("return_type").alias("returnType"),
        F.lit(False).alias("isAsync"), F.lit(False).alias("isStatic"), F.lit(False).alias("isAbstract"),
    )
    return F.to_json(F.struct(body.alias("node")))


def locations(found: DataFrame) -> list[dict]:
    return [
        {"name": r["name"], "kind": r["kind"], "filePath": r["file_path"], "startLine": r["start_line"]} for r in found.collect()
    ]


def callers_json(symbol: str, found: DataFrame, side: str = "callers") -> str:
    return dump({"symbol": symbol, side: locations(found)})


def impact_json(symbol: str, depth: int, found: DataFrame) -> str:
    first = found.first()
    return dump(
        {
            "symbol": symbol, "depth": depth, "nodeCount": first["node_count"] if first else 0,
            "edgeCount": first["edge_count"] if first else 0, "affected": locations(found),
        }
    )


def affected_json(files: list[str], found: DataFrame) -> str:
    return dump({"files": files, "affectedTests": locations(found)})


def files_json(found: DataFrame) -> str:
    rows = [{"path": r["path"], "language": r["language"], "nodeCount": r["node_count"], "edgeCount": r["edge_count"]} for r in found.collect()]
    return dump({"format": "flat", **({"files": rows} if rows else {})})


def sections(status: DataFrame) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in status.collect():  # kinds and languages
        out.setdefault(r["section"], {})[r["key"]] = r["n"]
    return out


def status_json(status: DataFrame, size_bytes: int, stale: bool) -> str:
    s = sections(status)
    total = s.get("total", {})
    return dump(
        {
            "fileCount": total.get("files", 0), "nodeCount": total.get("nodes", 0), "edgeCount": total.get("edges", 0),
            "nodesByKind": s.get("nodes_by_kind", {}), "edgesByKind": s.get("edges_by_kind", {}),
            "filesByLanguage": s.get("files_by_language", {}), "languages": sorted(s.get("files_by_language", {})),
            "dbSizeBytes": size_bytes, "stale": stale,
        }
    )


# ---- Markdown -------------------------------------------------------------------------------------------------------


def location_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    lines = [f"| `{r['name']}` | {r['kind']} | `{r['filePath']}:{r['startLine']}` |" for r in rows]
    return "\n".join(["| Name | Kind | Location |", "|---|---|---|", *lines]) + "\n"


def _titled(title: str, rows: list[dict], word: str, none: str) -> str:
    if not rows:
        return f"{title} — no {none} found.\n"
    return f"{title} — {len(rows)} {plural(len(rows), word)}\n\n{location_table(rows)}"


def callers_markdown(symbol: str, found: DataFrame) -> str:
    return _titled(f"**Callers of `{symbol}`**", locations(found), "caller", "callers")


def callees_markdown(symbol: str, found: DataFrame) -> str:
    return _titled(f"**Callees of `{symbol}`**", locations(found), "callee", "callees")


def search_markdown(term: str, found: DataFrame) -> str:
    return _titled(f"**Search: `{term}`**", locations(found), "result", "results")


def impact_markdown(symbol: str, depth: int, found: DataFrame) -> str:
    rows, first = locations(found), found.first()
    nodes, edges = (first["node_count"], first["edge_count"]) if first else (0, 0)
    head = f"**Impact of `{symbol}`** — depth {depth}, {nodes} nodes, {edges} edges"
    return f"{head}\n\n{location_table(rows)}" if rows else f"{head} — no affected symbols found.\n"


def files_markdown(found: DataFrame) -> str:
    rows = found.collect()
    if not rows:
        return "**Files** — no files found.\n"
    lines = [f"| `{r['path']}` | {r['language']} | {r['node_count']} | {r['edge_count']} |" for r in rows]
    return "\n".join([f"**Files** — {len(rows)} indexed\n", "| Path | Language | Nodes | Edges |", "|---|---|---|---|", *lines]) + "\n"


def tree_markdown(nested: dict, languages: dict[str, str], folder: str = "", indent: str = "") -> str:
    """A nested tree (name -> children, None for a file), folders first."""
    out = []
    for name, kids in sorted(nested.items(), key=lambda e: (e[1] is None, e[0])):
        path = f"{folder}/{name}" if folder else name
        if kids is None:
            out.append(f"{indent}{name} ({languages.get(path, '')})\n")
        else:
            out.append(f"{indent}{name}/\n{tree_markdown(kids, languages, path, indent + '  ')}")
    return "".join(out)


def status_markdown(status: DataFrame, size_bytes: int) -> str:
    s = sections(status)
    total = s.get("total", {})
    out = ["**Graph Status**\n"]
    for title, key in (("Files indexed", "files"), ("Total nodes", "nodes"), ("Total edges", "edges")):
        out.append(f"**{title}:** {number(total.get(key, 0))}")
    out.append(f"**Database size:** {megabytes(size_bytes)}")
    for title, key, zero in (("Nodes by Kind", "nodes_by_kind", False), ("Edges by Kind", "edges_by_kind", True), ("Languages", "files_by_language", False)):
        out.append(f"\n**{title}:**")
        rows = sorted(s.get(key, {}).items(), key=lambda e: (-e[1], e[0]))
        out += [f"- {k}: {number(n)}" for k, n in rows if n or zero]
    return "\n".join(out) + "\n"


def numbered(text: str, first: int = 1) -> str:
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return "\n".join(f"{first + k}\t{line}" for k, line in enumerate(lines))


def node_markdown(symbol: str, shown: DataFrame) -> str:
    """Definitions with the bodies that fit, the rest as a list. Rows of CodeGraph.node."""
    rows = [r.asDict() for r in shown.orderBy("pos").collect()]
    full, rest = [r for r in rows if r["shown"]], [r for r in rows if not r["shown"]]
    section = lambda r: (
        f"**{r['name']}** ({r['kind']})\n\n**Location:** {r['file_path']}:{r['start_line']}\n**Signature:** `{r['signature']}`\n\n"
        + numbered(r["body"], r["start_line"])
    )
    more = f"; {len(rest)} more listed below" if rest else ""
    out = f'**{len(rows)} definitions named "{symbol}"**\nReturning {len(full)} in full{more}.\n\n' + "\n\n---\n\n".join(map(section, full)) + "\n"
    if rest:
        out += "\n**Other definitions**\n" + "".join(f"- `{r['name']}` ({r['kind']}) — {r['file_path']}:{r['start_line']}\n" for r in rest[:MOST_LISTED])
        out += f"- … +{len(rest) - MOST_LISTED} more\n" if len(rest) > MOST_LISTED else ""
    return out


def explore_markdown(found, sources: dict[str, str] | None = None, stale: bool = False) -> str:
    """An Exploration with the source of its files (skeleton files show signatures only)."""
    rows = [r.asDict() for r in found.symbols.orderBy("position", "rank").collect()] if found.symbols is not None else []
    if not rows:
        return f"**Exploration: {found.query}**\n\nNothing found.\n"
    paths = list(dict.fromkeys(r["file_path"] for r in rows))
    out = ["> The index is older than the files on disk.\n\n" if stale else "", f"**Exploration: {found.query}**\n\n"]
    out.append(f"Found {len(rows)} {plural(len(rows), 'symbol')} across {len(paths)} {plural(len(paths), 'file')}.\n\n**Blast radius**\n\n")
    for r in rows:
        line = f"- `{r['name']}` ({r['file_path']}:{r['start_line']}) — {r['callers']} {plural(r['callers'], 'caller')}"
        if r["test_files"]:
            line += "; tests: " + ", ".join(f"`{t}`" for t in r["test_files"])
        elif r["callers"]:
            line += "; no covering tests found"
        out.append(line + "\n")
    out.append(f"\n**Source Code**\n\n> {DISCLAIMER}\n\n")
    for p in paths:
        own = [r for r in rows if r["file_path"] == p]
        out.append(f"**`{p}`** — " + ", ".join(f"{r['name']}({r['kind']})" for r in own) + "\n\n")
        if p in found.skeletons:
            out.append("```\n" + "".join(f"{r['kind']} {r['name']}\n" for r in own) + "```\n\n")
        elif sources and p in sources:
            out.append(numbered(sources[p]) + "\n\n")
    return "".join(out)
