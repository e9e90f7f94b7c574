"""Extractors of brace languages from tokens: Go, Java, C#, TypeScript and JavaScript, C, C++, Kotlin, PHP, Rust, Swift,
and Ruby by its keywords.

They find declarations, supertypes, imports, calls and (in the first tier) values that are read, made or returned. There is
no grammar behind them, so odd code may lose a reference; it never fails a batch.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from .rows import FileRows
from .tokens import Token, match_brackets, tokenize

_NO_CALL = frozenset(
    "if for while switch catch return func function fn fun def new sizeof typeof instanceof in of as is throw await yield else do try "
    "using lock foreach when match loop guard let var val const where select range defer go elif unless until and or not super_ "
    "synchronized nameof default delete void import require include require_once include_once echo print isset unset empty array list "
    "static_cast dynamic_cast const_cast reinterpret_cast alignof decltype assert init".split()
)
_LITERALS = frozenset("nil null None true false self this super undefined NULL nullptr it iota".split())


@dataclass
class Dialect:
    language: str
    types: dict[str, str]
    functions: tuple[str, ...] = ()
    typed_functions: bool = False  # C-like: a name before "(" and a body is a function
    modifiers: frozenset = frozenset()
    own: tuple[str, ...] = ("this",)
    supers: tuple[str, ...] = ()
    colon_supers: bool = False
    first_tier: bool = False
    hash_comments: bool = False
    char_quotes: bool = False
    package_word: str = ""
    makes_by_new: bool = True
    extra: dict = field(default_factory=dict)


DIALECTS = {
    d.language: d
    for d in (
        Dialect("java", {"class": "struct", "enum": "struct", "record": "struct", "interface": "interface"}, typed_functions=True, supers=("extends", "implements"), first_tier=True, char_quotes=True, package_word="package"),
        Dialect("csharp", {"class": "struct", "struct": "struct", "record": "struct", "enum": "struct", "interface": "interface"}, typed_functions=True, colon_supers=True, first_tier=True, char_quotes=True, package_word="namespace"),
        Dialect("typescript", {"class": "struct", "interface": "interface", "enum": "struct"}, functions=("function",), typed_functions=True, own=("this", "super"), supers=("extends", "implements"), first_tier=True),
        Dialect("c", {"struct": "struct", "union": "struct", "enum": "struct"}, typed_functions=True, char_quotes=True),
        Dialect("cpp", {"class": "struct", "struct": "struct", "union": "struct", "enum": "struct"}, typed_functions=True, colon_supers=True, char_quotes=True),
        Dialect("kotlin", {"class": "struct", "object": "struct", "interface": "interface"}, functions=("fun",), colon_supers=True, own=(), char_quotes=True, package_word="package", makes_by_new=False),
        Dialect("php", {"class": "struct", "trait": "struct", "interface": "interface", "enum": "struct"}, functions=("function",), supers=("extends", "implements"), own=("$this", "self", "static"), hash_comments=True, package_word="namespace"),
        Dialect("rust", {"struct": "struct", "enum": "struct", "trait": "interface", "union": "struct"}, functions=("fn",), own=("self", "Self"), char_quotes=True, makes_by_new=False),
        Dialect("swift", {"class": "struct", "struct": "struct", "enum": "struct", "actor": "struct", "protocol": "interface"}, functions=("func",), colon_supers=True, own=(), makes_by_new=False),
    )
}
DIALECTS["tsx"] = DIALECTS["javascript"] = DIALECTS["typescript"]


class Parser:
    def __init__(self, out: FileRows, text: str, dialect: Dialect):
        self.out, self.d = out, dialect
        self.t: list[Token] = tokenize(text, dialect.hash_comments, dialect.char_quotes)
        self.ends = match_brackets(self.t)

    def value(self, k: int) -> str:
        return self.t[k].value if 0 <= k < len(self.t) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def at(self, k: int) -> tuple[int, int]:
        return (self.t[k].line, self.t[k].col)

    def run(self) -> None:
        self.head()
        self.scan(0, len(self.t), None, "")

    def head(self) -> None:
        """Package and imports, per language."""
        out, lang = self.out, self.d.language
        for k, t in enumerate(self.t):
            if t.kind != "name":
                continue
            if t.value == self.d.package_word and self.d.package_word and k < 400:
                name, _ = self.dotted(k + 1)
                if name:
                    out.module_key = name.replace("::", ".").replace("\\", ".")
            elif t.value in ("import", "using", "use") and lang in ("java", "csharp", "kotlin", "php", "swift", "rust") and self.starts_statement(k):
                word = self.value(k + 1) in ("function", "const") and lang == "php"
                name, end = self.dotted(k + 1 + word)
                if not name or self.value(k + 1) == "(":
                    continue
                if lang == "php" and self.value(end) == "{":
                    self.group_use(name, end, self.at(k))
                    continue
                out.ref(out.file_id, "imports", name, at=self.at(k))
                parts = name.replace("::", ".").replace("\\", ".").split(".")
                alias = self.value(end + 1) if self.value(end) == "as" else parts[-1]
                if lang == "csharp":
                    out.use(parts[-1], name)
                elif len(parts) > 1 and parts[-1] != "*":
                    out.use(alias, ".".join(parts[:-1]))
                    out.origins[alias] = parts[-1]
            elif lang in ("typescript", "tsx", "javascript") and t.value in ("import", "require"):
                self.script_import(k)
            elif lang in ("c", "cpp") and t.value == "include" and self.value(k - 1) == "#":
                target = self.value(k + 1).strip('"') if self.t[k + 1 : k + 2] and self.t[k + 1].kind == "text" else "".join(self.value(j) for j in range(k + 2, min(k + 12, len(self.t))) if self.value(j) != ">")
                out.ref(out.file_id, "imports", target.split(">")[0], at=self.at(k))

    def group_use(self, prefix: str, brace: int, at: tuple[int, int]) -> None:
        """``use A\\B\\{C, D as E}``: an import and an alias for each name."""
        k = brace + 1
        while k < self.ends[brace]:
            name, end = self.dotted(k + (self.value(k) in ("function", "const")))
            if name:
                parts = f"{prefix}\\{name}".replace("\\", ".").split(".")
                alias = self.value(end + 1) if self.value(end) == "as" else parts[-1]
                self.out.ref(self.out.file_id, "imports", f"{prefix}\\{name}", at=at)
                self.out.use(alias, ".".join(parts[:-1]))
                self.out.origins[alias] = parts[-1]
            k = max(end, k)
            while k < self.ends[brace] and self.value(k) != ",":
                k += 1
            k += 1

    def starts_statement(self, k: int) -> bool:
        return k == 0 or self.value(k - 1) in (";", "{", "}", ">", "]") or self.t[k - 1].line < self.t[k].line or self.value(k - 1) in ("global", "pub")

    def dotted(self, k: int) -> tuple[str, int]:
        parts = []
        while k < len(self.t):
            if self.value(k) == "static" and not parts:
                k += 1
                continue
            if self.is_name(k) or self.value(k) == "*":
                parts.append(self.value(k))
                k += 1
                if self.value(k) in (".", "::", "\\"):
                    parts.append(self.value(k))
                    k += 1
                    continue
            elif self.value(k) == "\\" and not parts:
                k += 1
                continue
            break
        return "".join(parts).rstrip(".:\\"), k

    def script_import(self, k: int) -> None:
        out = self.out
        j = k + 1
        while j < len(self.t) and self.t[j].kind != "text" and self.value(j) != ";":
            j = self.ends[j] + 1 if self.value(j) == "{" else j + 1
        if j >= len(self.t) or self.t[j].kind != "text":
            return
        target = self.t[j].value.strip("\"'`")
        if target.startswith("."):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(out.path), target))
        else:
            target = aliased(target, out.script)
        target = strip_script(target)
        out.ref(out.file_id, "imports", target, at=self.at(k))
        m = k + 1
        if self.t[k].value == "require":
            m, j = max(0, k - 8), k
        while m < j:
            if self.is_name(m) and self.value(m) not in ("from", "as", "type", "const", "let", "var"):
                origin = self.value(m)
                if self.value(m + 1) == "as":
                    m += 2
                local = self.value(m)
                out.use(local, target)
                if self.value(m - 1) in ("{", ",", "as") or origin != local:
                    out.origins[local] = origin
            m += 1

    # ---- declarations -----------------------------------------------------------------------------------------------

    def scan(self, k: int, stop: int, owner: str | None, type_name: str) -> None:
        """Declarations from k to stop; ``owner`` is the enclosing type. Bodies are walked, not recursed into deeply."""
        todo = [(k, stop, owner, type_name)]
        for k, stop, owner, type_name in todo:
            while k < stop:
                t = self.t[k]
                if t.kind == "name" and t.value in self.d.types and self.is_name(k + 1) and self.value(k - 1) not in (".", "::", "new", "<", ",", "("):
                    k = self.type_declaration(k, stop, owner, type_name, todo)
                elif t.kind == "name" and t.value[:1] == "@" and t.value != "@interface":
                    _, k = self.dotted(k)  # an annotation with its arguments is no declaration
                    k = self.ends[k] + 1 if self.value(k) == "(" else k
                elif t.kind == "name" and t.value == "impl" and self.d.language == "rust":
                    k = self.rust_impl(k, stop, todo)
                elif t.kind == "name" and t.value == "extension" and self.d.language == "swift" and self.is_name(k + 1):
                    k = self.swift_extension(k, stop, todo)
                elif t.kind == "name" and t.value in ("typedef", "type", "typealias") and self.is_name(k + 1):
                    k = self.alias_declaration(k, stop, owner)
                elif t.kind == "name" and t.value in self.d.functions and self.d.functions and (self.is_name(k + 1) or self.value(k + 1) in ("*", "&")):
                    k = self.function(k + 1 + (not self.is_name(k + 1)), stop, owner, type_name)
                elif self.d.typed_functions and t.kind == "name" and self.value(k + 1) == "(" and t.value not in _NO_CALL and self.has_body(k, owner):
                    k = self.function(k, stop, owner, type_name)
                elif self.d.first_tier and self.d.language in ("typescript", "tsx", "javascript") and t.value in ("const", "let", "var") and self.is_name(k + 1) and owner is None:
                    k = self.script_constant(k, stop)
                elif t.value in ("(", "[") or (t.value == "{" and self.value(k - 1) in ("=", ",", "(", ":", "return")):
                    k = self.ends[k] + 1
                else:
                    if self.d.first_tier and owner and t.kind == "name" and self.is_name(k + 1) and self.value(k + 2) in ("=", ";") and t.value[:1].isupper():
                        self.out.ref(owner, "type_of", t.value, "", self.at(k))
                    k += 1

    def shown(self, k: int, name: str) -> dict:
        words = {self.value(j) for j in range(max(0, k - 6), k)}
        lang = self.d.language
        if lang in ("java", "csharp", "kotlin", "php", "swift"):
            default = "internal" if lang in ("csharp", "swift") else "public" if lang in ("kotlin", "php") else "package"
            v = next((w for w in ("private", "protected", "internal", "public", "open") if w in words), default)
            return dict(visibility="public" if v == "open" else v, exported=v in ("public", "open"))
        if lang in ("typescript", "tsx", "javascript"):
            return dict(visibility="public" if "export" in words else "module", exported="export" in words)
        if lang == "rust":
            return dict(visibility="public" if "pub" in words else "private", exported="pub" in words)
        return dict(visibility="public", exported="static" not in words)

    def body_of(self, k: int, stop: int) -> int:
        """Index of the "{" that opens a declaration's body, or -1."""
        while k < stop:
            v = self.value(k)
            if v == "{":
                return k
            if v in (";", "}"):
                return -1
            k = self.ends[k] + 1 if v in ("(", "[") else k + 1
        return -1

    def type_declaration(self, k: int, stop: int, owner: str | None, outer: str, todo: list) -> int:
        kind, name = self.d.types[self.value(k)], self.value(k + 1)
        if self.value(k) == "enum" and self.value(k + 1) == "class" and self.is_name(k + 2):
            k += 1
            name = self.value(k + 1)
        if self.d.language in ("c", "cpp") and self.value(k + 2) not in ("{", ":", "final"):
            return k + 2
        brace = self.body_of(k + 2, stop)
        if self.d.language == "kotlin" and brace > 0 and any(self.value(j) in ("fun", "class", "val", "interface") for j in range(k + 2, brace) if self.t[j].line > self.t[k].line and self.ends[j] == j):
            brace = -1
        end = self.ends[brace] if brace >= 0 else k + 1
        made = self.out.symbol(None, kind, name, start=self.at(k), end=self.at(min(end, len(self.t) - 1)), **self.shown(k, name))
        self.super_types(made, k + 2, brace if brace >= 0 else min(stop, k + 40))
        if brace >= 0:
            todo.append((brace + 1, end, made, name))
            return end + 1
        return k + 2

    def super_types(self, made: str, k: int, stop: int) -> None:
        listing, depth = False, 0
        while k < stop:
            v = self.value(k)
            if v == "<":
                depth += 1
            elif v == ">":
                depth = max(0, depth - 1)
            elif v in ("(", "["):
                k = self.ends[k]
            elif depth == 0 and (v in self.d.supers or (v == ":" and self.d.colon_supers)):
                listing = True
            elif v in (";", "where", "{") or (v == "permits"):
                break
            elif v == "by" and depth == 0 and listing:  # a delegate is an expression, no supertype
                while k + 1 < stop and self.value(k + 1) not in (",", "{"):
                    k = self.ends[k + 1] if self.value(k + 1) in ("(", "[") else k + 1
            elif depth == 0 and listing and self.is_name(k) and v not in ("public", "private", "protected", "virtual", "by"):
                name, end = self.dotted(k)
                last = name.replace("::", ".").replace("\\", ".").split(".")[-1]
                self.out.ref(made, "embeds", last, "", self.at(k))
                k = end
                continue
            k += 1

    def rust_impl(self, k: int, stop: int, todo: list) -> int:
        brace = self.body_of(k + 1, stop)
        if brace < 0:
            return k + 1
        names = []
        depth = 0
        for j in range(k + 1, brace):
            v = self.value(j)
            depth += (v == "<") - (v == ">")
            if depth == 0 and (self.is_name(j) and v != "where"):
                names.append(v)
        split = names.index("for") if "for" in names else -1
        target = names[-1] if names else ""
        if split > 0:
            target, trait = names[-1], names[split - 1]
            source = self.out.types.get(target)
            if source:
                self.out.ref(source, "embeds", trait, "", self.at(k))
        todo.append((brace + 1, self.ends[brace], self.out.types.get(target, ""), target))
        return self.ends[brace] + 1

    def swift_extension(self, k: int, stop: int, todo: list) -> int:
        brace = self.body_of(k + 1, stop)
        if brace < 0:
            return k + 1
        name = self.value(k + 1)
        made = self.out.types.get(name, "")
        if made:
            self.super_types(made, k + 2, brace)
        todo.append((brace + 1, self.ends[brace], made, name))
        return self.ends[brace] + 1

    def alias_declaration(self, k: int, stop: int, owner: str | None) -> int:
        word = self.value(k)
        end = k
        while end < stop and self.value(end) != ";" and not (word != "typedef" and end > k + 2 and self.t[end].line > self.t[k].line):
            end = self.ends[end] + 1 if self.value(end) in ("{", "(", "[") else end + 1
        if word == "typedef":
            name = self.value(end - 1)
        elif self.value(k + 2) in ("=", "<"):
            name = self.value(k + 1)
        else:
            return k + 1
        if name and name.isidentifier():
            self.out.symbol(owner, "type_alias", name, start=self.at(k), end=self.at(min(end, len(self.t) - 1)), **self.shown(k, name))
        return end + 1

    def has_body(self, k: int, owner: str | None) -> bool:
        """Is the name before "(" a function that is declared here?"""
        if self.value(k - 1) in (".", "->", "new", "=", "return", ",", "(", "?.", "!", "&&", "throw", "await", ":") and self.d.language not in ("typescript", "tsx", "javascript"):
            return False
        if self.value(k - 1) in (".", "=", "return", ",", "(", "new", "?.", "throw", "await", "!"):
            return False
        k = self.ends[k + 1] + 1
        steps = 0
        while k < len(self.t) and steps < 40:
            v = self.value(k)
            if v == "{":
                return True
            if v == "=>" and self.d.language == "csharp":
                return True
            if v == ";" and owner is not None and self.d.language in ("java", "csharp", "typescript", "tsx"):
                return self.is_name(k - 1) or self.value(k - 1) in (")", ">", "]")
            if v in (";", "}", "=", ",", ")") or (self.t[k].kind == "mark" and v in ("+", "-", "*", "/", "?", ".", "&", "|")):
                return self.d.language in ("c", "cpp") and v == ";" and owner is None and self.is_name(k - 2)
            k = self.ends[k] + 1 if v in ("(", "[") else k + 1
            steps += 1
        return False

    def function(self, k: int, stop: int, owner: str | None, type_name: str) -> int:
        name = self.value(k)
        if self.d.language == "kotlin":
            while self.value(k + 1) == "." and self.is_name(k + 2):
                k += 2
                name = self.value(k)
        paren = k + 1
        if self.value(paren) == "<":
            while paren < stop and self.value(paren) != "(":
                paren += 1
        if self.value(paren) != "(":
            return k + 1
        after = self.ends[paren] + 1
        body = self.body_of(after, stop)
        if self.d.language in ("kotlin", "csharp", "swift") and body < 0:
            end = after
            while end < stop and self.value(end) not in (";", "}") and self.t[end].line == self.t[after - 1].line:
                end = self.ends[end] + 1
            span = (after, end)
        else:
            span = (body + 1, self.ends[body]) if body >= 0 else (after, after)
        if self.value(k - 1) == "::" and self.is_name(k - 2) and self.d.language == "cpp":
            type_name, owner = self.value(k - 2), self.out.types.get(self.value(k - 2), "")
        kind = "method" if type_name else "function"
        qualified = f"{type_name}.{name}" if type_name else name
        returns = self.return_type(k, after, body if body >= 0 else span[1])
        signature = "(" + " ".join(self.value(j) for j in range(paren + 1, self.ends[paren])) + ")"
        last = self.at(min(max(span[1], after - 1), len(self.t) - 1))
        where = dict(start=self.at(k), end=last, signature=signature, returns=returns, **self.shown(k, name))
        if type_name and owner == "":  # the type lives in another file
            made = self.out.node(kind, name, qualified, **where)
            self.out.ref(made, "contains", type_name, "", self.at(k))
        else:
            made = self.out.symbol(owner, kind, name, qualified, **where)
        if self.d.first_tier and returns and returns.isidentifier() and returns[:1].isupper():
            self.out.ref(made, "returns", returns, "", self.at(k))
        self.body(made, *span)
        return max(span[1], after)

    def return_type(self, k: int, after: int, stop: int) -> str:
        if self.d.language in ("java", "csharp", "c", "cpp") and self.is_name(k - 1) and self.value(k - 1) not in ("public", "private", "protected", "static", "void"):
            return self.value(k - 1)
        if self.value(after) in (":", "->") and self.is_name(after + 1):
            return self.value(after + 1)
        return ""

    def script_constant(self, k: int, stop: int) -> int:
        name, words = self.value(k + 1), {self.value(j) for j in range(max(0, k - 3), k)}
        end = k + 2
        arrow = False
        while end < stop and self.value(end) != ";" and not (self.t[end].line > self.t[end - 1].line and self.value(end) in ("const", "let", "var", "export", "function", "class", "import", "interface", "type")):
            arrow |= self.value(end) in ("=>", "function")
            end = self.ends[end] + 1 if self.value(end) in ("(", "[", "{") else end + 1
        if "export" in words:
            made = self.out.symbol(None, "function" if arrow else "constant", name, start=self.at(k), end=self.at(min(end, len(self.t)) - 1), visibility="public", exported=True)
            self.body(made, k + 2, end)
        return end

    # ---- bodies -----------------------------------------------------------------------------------------------------

    def body(self, made: str, k: int, stop: int) -> None:
        for j in range(k, min(stop, len(self.t))):
            if not self.is_name(j):
                continue
            v, before, after = self.value(j), self.value(j - 1), self.value(j + 1)
            opens = after == "(" or (after == "!" and self.value(j + 2) == "(" and self.d.language == "rust")
            if before == "new" and self.d.makes_by_new:
                name, end = self.dotted(j)
                if self.d.first_tier:
                    self.out.ref(made, "instantiates", name.split(".")[-1], "", self.at(j))
                continue
            if opens and (v not in _NO_CALL or before in (".", "->", "::", "?.")) and before not in self.d.functions and before not in ("new", "func", "fun", "fn", "function"):
                self.call(made, j)
            elif self.d.first_tier and not opens:
                self.read(made, j, v, before, after)

    def call(self, made: str, j: int) -> None:
        dots = (".", "->", "::", "?.", "\\")
        if self.value(j - 1) not in dots:
            return self.out.ref(made, "calls", self.value(j), "", self.at(j))
        receiver = self.value(j - 2) if self.is_name(j - 2) and self.value(j - 3) not in dots else None
        self.out.ref(made, "calls", self.value(j), self.out.alias_of(receiver, self.d.own), self.at(j))

    def read(self, made: str, j: int, v: str, before: str, after: str) -> None:
        """A bare name as an argument, a returned value or a right-hand side."""
        lead = before in ("(", ",", "=", "return", ":=", "+", "!", "==") and self.t[j - 1].value != "->"
        if lead and after in (")", ",", ";", "+", "", "}") and v not in _LITERALS and v not in _NO_CALL:
            self.out.ref(made, "references", v, "", self.at(j))
        elif lead and after == "." and v in self.out.imports and self.is_name(j + 2) and self.value(j + 3) in (")", ",", ";", "", "}"):
            self.out.ref(made, "references", self.value(j + 2), v, self.at(j))


def aliased(target: str, options: dict) -> str:
    """A specifier that is not relative, by the compiler's ``paths`` (in the order of their patterns), else ``baseUrl``."""
    base = options.get("baseUrl") or ""
    base = "" if base == "." else base
    for pattern, places in sorted((options.get("paths") or {}).items()):
        head, star, tail = pattern.partition("*")
        fits = len(target) >= len(head) + len(tail) and target.startswith(head) and target.endswith(tail) if star else target == pattern
        if fits and places:
            return posixpath.normpath(posixpath.join(base, places[0].replace("*", target[len(head) : len(target) - len(tail)], 1)))
    return posixpath.normpath(posixpath.join(base, target)) if base else target


def strip_script(path: str) -> str:
    for end in (".d.ts", ".tsx", ".ts", ".jsx", ".mjs", ".cjs", ".js"):
        if path.endswith(end):
            return path[: -len(end)]
    return path


def extract(out: FileRows, text: str) -> None:
    Parser(out, text, DIALECTS[out.language]).run()


def extract_ruby(out: FileRows, text: str) -> None:
    """Ruby by lines: class, module and def open blocks that an ``end`` at their column closes."""
    stack: list[tuple[int, str, str, dict | None]] = []
    owner_now: str | None = None
    name_now, fn = "", None
    toks_by_line: dict[int, list[Token]] = {}
    for t in tokenize(text, hash_comments=True):
        toks_by_line.setdefault(t.line, []).append(t)
    for line in sorted(toks_by_line):
        toks = toks_by_line[line]
        first = toks[0]
        if first.value in ("class", "module") and len(toks) > 1:
            name = toks[1].value
            k = 2
            while k + 1 < len(toks) and toks[k].value == "::":
                name, k = toks[k + 1].value, k + 2
            made = out.symbol(None, "struct", name, start=(line, first.col), visibility="public", exported=True)
            if k + 1 < len(toks) and toks[k].value == "<":
                out.ref(made, "embeds", toks[-1].value, "", (line, toks[k + 1].col))
            stack.append((first.col, "type", name, None))
            owner_now, name_now = made, name
        elif first.value == "def" and len(toks) > 1:
            name = toks[3].value if len(toks) > 3 and toks[1].value == "self" and toks[2].value == "." else toks[1].value
            kind = "method" if owner_now else "function"
            fn = out.symbol(owner_now, kind, name, f"{name_now}.{name}" if name_now else name, start=(line, first.col), visibility="public", exported=True)
            stack.append((first.col, "def", name, None))
        elif first.value == "end" and stack and stack[-1][0] >= first.col:
            _, kind, _, _ = stack.pop()
            closing = fn if kind == "def" else owner_now
            for n in out.nodes:
                if n["id"] == closing:
                    n["end_line"], n["end_col"] = line, first.col + 3
            if kind == "def":
                fn = None
            else:
                types = [s for s in stack if s[1] == "type"]
                name_now = types[-1][2] if types else ""
                owner_now = out.types.get(name_now)
        elif first.value in ("require", "require_relative") and len(toks) > 1:
            target = toks[1].value.strip("\"'")
            if first.value == "require_relative":
                target = posixpath.normpath(posixpath.join(posixpath.dirname(out.path), target))
            out.ref(out.file_id, "imports", target, at=(line, first.col))
        elif fn:
            for k, t in enumerate(toks):
                dotted = k > 0 and toks[k - 1].value in (".", "::")
                called = (k + 1 < len(toks) and toks[k + 1].value == "(") or dotted
                if t.kind != "name" or t.value in _NO_CALL or not called:
                    continue
                receiver = toks[k - 2].value if dotted and k > 1 and toks[k - 2].kind == "name" else None
                alias = out.alias_of(receiver, ("self",)) if dotted else ""
                out.ref(fn, "calls", t.value, alias, (line, t.col))


# ---- Go --------------------------------------------------------------------------------------------------------------

_PREDECLARED = frozenset(
    "bool byte rune string error any int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 "
    "complex128 append cap clear close complex copy delete imag len make max min new panic print println real recover".split()
)


class GoParser(Parser):
    def __init__(self, out: FileRows, text: str):
        super().__init__(out, text, Dialect("go", {}, first_tier=True, char_quotes=True, makes_by_new=False))

    def run(self) -> None:
        k = 0
        bodies: list[tuple[str, int, int]] = []
        while k < len(self.t):
            v = self.value(k)
            if v == "import":
                k = self.go_imports(k)
            elif v == "type":
                k = self.group(k + 1, self.go_type)
            elif v in ("const", "var"):
                k = self.group(k + 1, lambda j, e, kind=("constant" if v == "const" else "variable"): self.go_value(j, e, kind))
            elif v == "func":
                k = self.go_func(k, bodies)
            else:
                k = self.ends[k] + 1
        self.methods_of()
        for made, a, b in bodies:
            self.go_body(made, a, b)

    def shown(self, k: int, name: str) -> dict:
        public = name[:1].isupper()
        return dict(visibility="public" if public else "package", exported=public)

    def go_imports(self, k: int) -> int:
        lo, hi = (k + 2, self.ends[k + 1]) if self.value(k + 1) == "(" else (k + 1, k + 3)
        j = lo
        while j < min(hi, len(self.t)):
            if self.t[j].kind == "text":
                path = self.t[j].value.strip('"`')
                named = self.t[j - 1].line == self.t[j].line and j - 1 >= lo and (self.is_name(j - 1) or self.value(j - 1) == ".")
                alias = self.value(j - 1) if named else path.rsplit("/", 1)[-1]
                if alias not in ("_", "."):
                    self.out.use(alias, path)
                self.out.ref(self.out.file_id, "imports", path, at=self.at(j))
                if self.value(k + 1) != "(":
                    return j + 1
            j += 1
        return hi + 1

    def group(self, k: int, one) -> int:
        """A declaration, or a parenthesised list of them, a line or bracket block each."""
        lo, hi = (k + 1, self.ends[k]) if self.value(k) == "(" else (k, len(self.t))
        j = lo
        while j < hi:
            end = j
            while end < hi and (end == j or self.t[end].line == self.t[end - 1].line):
                end = self.ends[end] + 1
                if end < len(self.t) and self.value(end) == ";":
                    break
            one(j, min(end, hi))
            j = end
            if self.value(k) != "(":
                return j
        return hi + 1

    def go_type(self, j: int, end: int) -> None:
        if not self.is_name(j):
            return
        name, b = self.value(j), j + 1
        if self.value(b) == "[" and self.is_name(b + 1) and self.ends[b] > b + 2:
            b = self.ends[b] + 1
        if self.value(b) == "=":
            b += 1
        kind = {"struct": "struct", "interface": "interface"}.get(self.value(b), "type_alias")
        made = self.out.symbol(None, kind, name, start=self.at(j), end=self.at(min(end, len(self.t)) - 1), **self.shown(j, name))
        if kind == "type_alias":
            return
        brace = b + 1
        lines: dict[int, list[int]] = {}
        q = brace + 1
        while q < self.ends[brace]:
            lines.setdefault(self.t[q].line, []).append(q)
            if self.value(q) in ("(", "{", "["):
                lines[self.t[q].line].append(self.ends[q])
                q = self.ends[q]
            q += 1
        for toks in lines.values():
            v = [self.value(x) for x in toks]
            if kind == "interface" and len(v) >= 3 and v[1] == "(" and self.is_name(toks[0]):
                self.out.iface_methods.append(dict(iface_id=made, name=v[0], arity=self.arity(toks[1])))
                continue
            words = [x for x in toks if self.t[x].kind != "text"]
            star = self.value(words[0]) == "*" if words else False
            w = words[star:]
            if len(w) == 1 and self.is_name(w[0]):
                self.out.ref(made, "embeds", self.value(w[0]), "", self.at(w[0]))
            elif len(w) == 3 and self.value(w[1]) == "." and self.is_name(w[2]):
                self.out.ref(made, "embeds", self.value(w[2]), self.value(w[0]), self.at(w[0]))

    def arity(self, paren: int) -> int:
        """Parameters of a list: ``a, b int`` are two, an unnamed one counts one."""
        n, k, end = 0, paren + 1, self.ends[paren]
        seen = False
        while k < end:
            if self.value(k) == ",":
                n += 1
                seen = False
            else:
                seen = True
            k = self.ends[k] + 1
        return n + seen if end > paren + 1 else 0

    def go_value(self, j: int, end: int, kind: str) -> None:
        k = j
        names = []
        while self.is_name(k):
            names.append(k)
            k += 1
            if self.value(k) != ",":
                break
            k += 1
        for x in names:
            if self.value(x) != "_":
                made = self.out.symbol(None, kind, self.value(x), start=self.at(x), end=self.at(min(end, len(self.t)) - 1), **self.shown(x, self.value(x)))
                if kind == "variable" and k < end:
                    self.type_ref(made, "type_of", k + (self.value(k) == "*"), end)

    def type_ref(self, made: str, kind: str, k: int, end: int) -> None:
        if k < end and self.is_name(k) and self.value(k) not in _PREDECLARED and self.value(k) not in ("map", "chan", "func", "struct", "interface"):
            if self.value(k + 1) == "." and self.is_name(k + 2):
                self.out.ref(made, kind, self.value(k + 2), self.value(k), self.at(k))
            else:
                self.out.ref(made, kind, self.value(k), "", self.at(k))

    def go_func(self, k: int, bodies: list) -> int:
        start, j, recv = k, k + 1, ""
        if self.value(j) == "(":
            inside = [self.value(x) for x in range(j + 1, self.ends[j]) if self.is_name(x)]
            recv = inside[1] if len(inside) > 1 else inside[0] if inside else ""
            j = self.ends[j] + 1
        if not self.is_name(j):
            return self.ends[k] + 1
        name, paren = self.value(j), j + 1
        if self.value(paren) == "[":
            paren = self.ends[paren] + 1
        if self.value(paren) != "(":
            return paren
        after = self.ends[paren] + 1
        brace = after
        while brace < len(self.t) and self.value(brace) != "{" and self.t[brace].line == self.t[brace - 1].line:
            brace = self.ends[brace] + 1
        has = brace < len(self.t) and self.value(brace) == "{"
        end = self.ends[brace] if has else after - 1
        signature = "(" + " ".join(self.value(x) for x in range(paren + 1, self.ends[paren])) + ")"
        returns = " ".join(self.value(x) for x in range(after, brace)) if brace > after else ""
        where = dict(start=self.at(start), end=self.at(end), signature=signature, returns=returns, **self.shown(j, name))
        if not recv:
            made = self.out.symbol(None, "function", name, **where)
        else:
            made = self.out.node("method", name, f"{recv}.{name}", **where)
            self.out.method_arity.append(dict(method_id=made, arity=self.arity(paren)))
            self.pending_methods.append((made, recv, self.at(start)))
        self.type_ref(made, "returns", after + (self.value(after) == "*"), brace)
        if has:
            bodies.append((made, brace + 1, end))
        return end + 1

    @property
    def pending_methods(self) -> list:
        return self.__dict__.setdefault("_methods", [])

    def methods_of(self) -> None:
        for made, recv, at in self.pending_methods:
            if recv in self.out.types:
                self.out.edge(self.out.types[recv], made)
            else:
                self.out.ref(made, "contains", recv, "", at)

    def go_body(self, made: str, k: int, stop: int) -> None:
        local: set[str] = set()
        for j in range(k, stop):
            if self.value(j) == ":=":
                m = j - 1
                while self.is_name(m):
                    local.add(self.value(m))
                    if self.value(m - 1) != ",":
                        break
                    m -= 2
        for j in range(k, stop):
            if not self.is_name(j):
                continue
            v, before, after = self.value(j), self.value(j - 1), self.value(j + 1)
            if after == "(" and v not in _NO_CALL and v not in _PREDECLARED and before != "func":
                if before == ".":
                    plain = self.is_name(j - 2) and self.value(j - 3) != "."
                    self.out.ref(made, "calls", v, self.value(j - 2) if plain else "<expression>", self.at(j))
                else:
                    self.out.ref(made, "calls", v, "", self.at(j))
            elif after == "{" and v[:1].isalpha() and before in ("=", ":=", "&", "return", "(", ",", ".", "{", ":", "]") and v not in _NO_CALL:
                if before == "." and self.is_name(j - 2):
                    self.out.ref(made, "instantiates", v, self.value(j - 2), self.at(j))
                elif before != ".":
                    self.out.ref(made, "instantiates", v, "", self.at(j))
            elif before in ("(", ",", "=", ":=", "return", "+", "&") and v not in local and v not in _PREDECLARED:
                self.read(made, j, v, before, after if self.t[j + 1 : j + 2] and self.t[j + 1].line == self.t[j].line else ";")


def extract_go(out: FileRows, text: str) -> None:
    GoParser(out, text).run()
