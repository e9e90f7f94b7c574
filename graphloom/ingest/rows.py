"""What an extractor emits for one file, and identifiers as the column form computes them."""

from __future__ import annotations

import hashlib


def node_id(kind: str, qualified_name: str, path: str) -> str:
    h = hashlib.sha256()
    for part in (kind, qualified_name, path):
        raw = part.encode()
        n = len(raw)
        size = bytearray()
        while True:
            size.append((n & 127) | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                break
        h.update(bytes(size) + raw)
    return f"{kind}:{h.hexdigest()[:32]}"


class FileRows:
    """Nodes, edges inside the file, references, imports and method shapes of one source file."""

    def __init__(self, path: str, language: str, module_key: str):
        self.path, self.language, self.module_key = path, language, module_key
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.refs: list[dict] = []
        self.imports: dict[str, str] = {}
        self.origins: dict[str, str] = {}  # local name -> name in the module it comes from
        self.iface_methods: list[dict] = []
        self.method_arity: list[dict] = []
        self.types: dict[str, str] = {}
        self.ids: set[str] = set()
        self.error = ""
        self.script: dict = {}
        self.file_id = self.node("file", path.rsplit("/", 1)[-1], path)

    def node(self, kind, name, qualified=None, start=(1, 0), end=None, visibility="", exported=False, signature="", returns="") -> str:
        qualified = name if qualified is None else qualified
        made = node_id(kind, qualified, self.path)
        end = end or start
        if made not in self.ids:  # overloads of one name share an id: the first stays
            self.ids.add(made)
            self.nodes.append(
                dict(
                    id=made, kind=kind, name=name, qualified_name=qualified, file_path=self.path, language=self.language,
                    start_line=start[0], end_line=end[0], start_col=start[1], end_col=end[1], signature=signature,
                    docstring="", visibility=visibility, is_exported=exported, return_type=returns,
                )
            )
        return made

    def symbol(self, owner: str | None, kind: str, name: str, qualified=None, **where) -> str:
        """A node with its ``contains`` edge from its owner or the file."""
        made = self.node(kind, name, qualified, **where)
        self.edge(owner or self.file_id, made)
        if kind in ("struct", "interface", "type_alias"):
            self.types.setdefault(name, made)
        return made

    def edge(self, source: str, target: str, kind: str = "contains", line: int = 0, col: int = 0) -> None:
        self.edges.append(dict(source=source, target=target, kind=kind, line=line, col=col, provenance="ast", metadata=[]))

    def ref(self, source: str, kind: str, name: str, alias: str = "", at=(0, 0)) -> None:
        if alias == "" and name in self.origins and kind != "imports":
            alias, name = name, self.origins[name]
        self.refs.append(
            dict(
                file=self.path, module_key=self.module_key, from_id=source, name=name, pkg_alias=alias, kind=kind,
                line=at[0], col=at[1], seq=len(self.refs),
            )
        )

    def use(self, alias: str, module: str) -> None:
        self.imports.setdefault(alias, module)

    def alias_of(self, receiver: str | None, own=("this", "self")) -> str:
        """Alias of a receiver: own module, an import, a type of this module, a local, or no name at all (None)."""
        if receiver is None:
            return "<expression>"
        if receiver in own:
            return ""
        if receiver in self.imports:
            return receiver
        return "" if receiver[:1].isupper() else f"<local:{receiver}>"

    def row(self) -> dict:
        return dict(
            path=self.path, language=self.language, module_key=self.module_key, nodes=self.nodes, edges=self.edges, refs=self.refs,
            imports=[dict(file=self.path, alias=a, target_module=m) for a, m in self.imports.items()],
            iface_methods=self.iface_methods, method_arity=self.method_arity, error=self.error,
        )
