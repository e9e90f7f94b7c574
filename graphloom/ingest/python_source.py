"""Python extractor on the standard parser."""

from __future__ import annotations

import ast

from .rows import FileRows


def _package_up(module: str, levels: int, is_package: bool) -> str:
    parts = module.split(".")
    drop = levels - (1 if is_package else 0)
    return ".".join(parts[: max(0, len(parts) - drop)])


def parsed(text: str) -> tuple[ast.Module, str]:
    """The tree of a module and its first error; around syntax errors, of the top-level statements that are right.

    First the lines in error are taken out one by one; a file with more of them is read statement by statement.
    """
    lines = text.split("\n")
    error = ""
    for _ in range(20):
        try:
            return ast.parse("\n".join(lines)), error
        except SyntaxError as why:
            error = error or f"SyntaxError: {why}"[:500]
            k = min(max((why.lineno or 1) - 1, 0), len(lines) - 1)
            now = lines[k]
            gone = now[: len(now) - len(now.lstrip())] + "pass"
            lines[k] = "" if now == gone else gone
    starts = [k for k, line in enumerate(lines) if line[:1] not in ("", " ", "\t", "#", ")", "]", "}")]
    body: list[ast.stmt] = []
    for lo, hi in zip(starts, [*starts[1:], len(lines)], strict=True):
        try:
            found = ast.parse("\n".join(lines[lo:hi]))
        except SyntaxError:
            continue
        body += ast.increment_lineno(found, lo).body
    return ast.Module(body=body, type_ignores=[]), error


def extract(out: FileRows, text: str) -> None:
    tree, out.error = parsed(text)  # the file keeps both its error and its symbols
    is_package = out.path.endswith("__init__.py")
    _imports(out, tree, is_package)
    todo: list[tuple[ast.AST, str | None, str]] = [(n, None, "") for n in tree.body]
    for node, owner, prefix in todo:  # grows while it is walked: no recursion
        if isinstance(node, ast.ClassDef):
            at = _span(node)
            made = out.symbol(owner, "struct", node.name, prefix + node.name, **at, **_shown(node.name))
            for base in node.bases:
                name, alias = _named(out, base)
                if name:
                    out.ref(made, "embeds", name, alias, (base.lineno, base.col_offset))
            for item in node.body:
                if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    _function(out, item, made, f"{node.name}.", "method")
                elif isinstance(item, ast.AnnAssign):
                    _typed(out, made, item.annotation, "type_of")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            _function(out, node, None, "", "function")
        elif isinstance(node, (ast.If, ast.Try)):
            todo += [(n, owner, prefix) for n in ast.iter_child_nodes(node) if isinstance(n, ast.stmt)]


def _shown(name: str) -> dict:
    private = name.startswith("_")
    return dict(visibility="private" if private else "public", exported=not private)


def _span(node) -> dict:
    return dict(start=(node.lineno, node.col_offset), end=(node.end_lineno, node.end_col_offset))


def _imports(out: FileRows, tree: ast.Module, is_package: bool) -> None:
    for node in ast.walk(tree):
        at = (getattr(node, "lineno", 0), getattr(node, "col_offset", 0))
        if isinstance(node, ast.Import):
            for a in node.names:
                out.use(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
                out.ref(out.file_id, "imports", a.name, at=at)
        elif isinstance(node, ast.ImportFrom):
            module = node.module or ""
            if node.level:
                up = _package_up(out.module_key, node.level, is_package)
                module = ".".join(x for x in (up, module) if x)
            out.ref(out.file_id, "imports", module, at=at)
            for a in node.names:
                local = a.asname or a.name
                if a.name != "*":
                    out.use(local, module)
                    out.origins[local] = a.name


def _named(out: FileRows, node) -> tuple[str, str]:
    """Name and alias of a name, attribute or subscripted type; empty if it is none."""
    if isinstance(node, ast.Subscript):
        node = node.value
    if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
        return node.value, ""
    if isinstance(node, ast.Name):
        return node.id, ""
    if isinstance(node, ast.Attribute):
        receiver = node.value.id if isinstance(node.value, ast.Name) else None
        return node.attr, out.alias_of(receiver, ("self", "cls"))
    return "", ""


_BUILTIN = frozenset("int str float bool bytes list dict set tuple object None Any Optional Union List Dict Set Tuple".split())


def _typed(out: FileRows, owner: str, annotation, kind: str) -> None:
    if annotation is None:
        return
    name, alias = _named(out, annotation)
    if name and name not in _BUILTIN:
        out.ref(owner, kind, name, alias, (annotation.lineno, annotation.col_offset))


def _function(out: FileRows, node, owner: str | None, prefix: str, kind: str) -> None:
    args = node.args
    count = len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg)
    returns = ast.unparse(node.returns) if node.returns else ""
    signature = f"({ast.unparse(args)})" + (f" -> {returns}" if returns else "")
    made = out.symbol(owner, kind, node.name, prefix + node.name, **_span(node), **_shown(node.name), signature=signature, returns=returns)
    del count  # arity is matched by name only for this language
    _typed(out, made, node.returns, "returns")
    locals_ = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]}
    values: list[ast.AST] = []
    todo: list[ast.AST] = list(node.body)
    for item in todo:
        if isinstance(item, ast.Call):
            _call(out, made, item)
            values += [*item.args, *(k.value for k in item.keywords)]
        elif isinstance(item, ast.Return) and item.value:
            values.append(item.value)
        elif isinstance(item, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and item.value:
            values.append(item.value)
        if isinstance(item, ast.Assign):
            locals_ |= {t.id for t in item.targets if isinstance(t, ast.Name)}
        if isinstance(item, ast.AnnAssign):
            _typed(out, made, item.annotation, "type_of")
        todo += ast.iter_child_nodes(item)
    for value in values:  # grows: parentheses, operators and containers are looked through
        if isinstance(value, (ast.BinOp,)):
            values += [value.left, value.right]
        elif isinstance(value, ast.UnaryOp):
            values.append(value.operand)
        elif isinstance(value, ast.BoolOp):
            values += value.values
        elif isinstance(value, ast.Name) and value.id not in locals_ and value.id not in ("self", "cls"):
            out.ref(made, "references", value.id, "", (value.lineno, value.col_offset))
        elif isinstance(value, ast.Attribute) and isinstance(value.value, ast.Name) and value.value.id in out.imports:
            out.ref(made, "references", value.attr, value.value.id, (value.lineno, value.col_offset))


def _call(out: FileRows, owner: str, node: ast.Call) -> None:
    f, at = node.func, (node.lineno, node.col_offset)
    if isinstance(f, ast.Name):
        name, alias = f.id, ""
    elif isinstance(f, ast.Attribute):
        name, alias = f.attr, out.alias_of(f.value.id if isinstance(f.value, ast.Name) else None, ("self", "cls"))
    else:
        return
    out.ref(owner, "calls", name, alias, at)
    if name[:1].isupper():
        out.ref(owner, "instantiates", name, alias, at)
