"""Route detectors of eight web frameworks over tokens: (verb, path, handler by name or by the next declaration)."""

from __future__ import annotations

import re
from typing import NamedTuple

# What a manifest must hold for a detector to run.
SIGNATURES = {
    "gin": ("go", ("gin-gonic/gin",)),
    "django": ("python", ("django", "Django")),
    "flask": ("python", ("flask", "Flask")),
    "fastapi": ("python", ("fastapi", "FastAPI")),
    "express": ("javascript", ('"express"',)),
    "nestjs": ("typescript", ("@nestjs",)),
    "spring": ("java", ("org.springframework",)),
    "aspnet": ("csharp", ("Microsoft.AspNetCore",)),
}
MANIFESTS = (
    "go.mod", "requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "package.json", "pom.xml", "build.gradle", "build.gradle.kts",
)
SCRIPT = ("javascript", "typescript", "tsx")


class Route(NamedTuple):
    verb: str
    path: str
    handler: str  # a name, or "" for the declaration that follows
    line: int
    col: int


_TEXT = r"""["'`]([^"'`]*)["'`]"""
_GIN = re.compile(rf"\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any)\(\s*{_TEXT}\s*,\s*([A-Za-z_]\w*)\s*[,)]")
_EXPRESS = re.compile(rf"\b(?:app|router)\.(get|post|put|patch|delete|head|options|all)\(\s*{_TEXT}\s*,\s*(?:[\w.]+\s*,\s*)*([A-Za-z_]\w*)\s*\)")
_DJANGO = re.compile(rf"\b(?:path|re_path|url)\(\s*r?{_TEXT}\s*,\s*(?:\w+\.)*([A-Za-z_]\w*)\s*[,)]")
_FLASK = re.compile(rf"@\w+\.route\(\s*{_TEXT}([^)]*)\)")
_VERBED = re.compile(rf"@\w+\.(get|post|put|patch|delete|head|options)\(\s*{_TEXT}")
_NEST = re.compile(rf"@(Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*(?:{_TEXT})?\s*\)")
_NEST_BASE = re.compile(rf"@Controller\(\s*(?:{_TEXT})?\s*\)")
_SPRING = re.compile(rf"@(Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:\{{\s*)?{_TEXT}[^)]*\)|\(\s*\)|(?![\w(]))")
_SPRING_BASE = re.compile(rf"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?{_TEXT}[^)]*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+|abstract\s+|final\s+)*class\b")
_ASPNET = re.compile(rf"\[Http(Get|Post|Put|Patch|Delete|Head|Options)(?:\(\s*{_TEXT}[^)]*\))?\]")
_ASPNET_MAP = re.compile(rf"\.Map(Get|Post|Put|Patch|Delete)\(\s*{_TEXT}\s*,\s*(?:\w+\.)*([A-Za-z_]\w*)\s*\)")
_ASPNET_BASE = re.compile(rf"\[Route\(\s*{_TEXT}\s*\)\]")


def fired(language: str, manifest: str) -> list[str]:
    same = lambda a: a == language or (a in SCRIPT and language in SCRIPT)
    return [d for d, (lang, marks) in SIGNATURES.items() if same(lang) and any(m in manifest for m in marks)]


def _join(base: str, path: str) -> str:
    if not base:
        return path
    return "/" + "/".join(x for x in (base.strip("/"), path.strip("/")) if x)


def detect(framework: str, source: str) -> list[Route]:
    at = lambda m: (source.count("\n", 0, m.start()) + 1, m.start() - source.rfind("\n", 0, m.start()) - 1)
    base = lambda p: next((m.group(1) or "" for m in p.finditer(source)), "")
    out: list[Route] = []
    if framework == "gin":
        out += [Route("ANY" if m[1] == "Any" else m[1], m[2], m[3], *at(m)) for m in _GIN.finditer(source)]
    elif framework == "express":
        out += [Route(m[1].upper(), m[2], m[3], *at(m)) for m in _EXPRESS.finditer(source)]
    elif framework == "django":
        out += [Route("ANY", m[1], m[2], *at(m)) for m in _DJANGO.finditer(source) if m[2] != "include"]
    elif framework == "flask":
        for m in _FLASK.finditer(source):
            verbs = re.findall(r"[A-Za-z]+", m[2].partition("methods")[2]) or ["GET"]
            out += [Route(v.upper(), m[1], "", *at(m)) for v in verbs]
        out += [Route(m[1].upper(), m[2], "", *at(m)) for m in _VERBED.finditer(source)]
    elif framework == "fastapi":
        out += [Route(m[1].upper(), m[2], "", *at(m)) for m in _VERBED.finditer(source)]
    elif framework == "nestjs":
        out += [Route(m[1].upper(), _join(base(_NEST_BASE), m[2] or ""), "", *at(m)) for m in _NEST.finditer(source)]
    elif framework == "spring":
        out += [Route(m[1].upper(), _join(base(_SPRING_BASE), m[2] or ""), "", *at(m)) for m in _SPRING.finditer(source)]
    elif framework == "aspnet":
        out += [Route(m[1].upper(), _join(base(_ASPNET_BASE), m[2] or ""), "", *at(m)) for m in _ASPNET.finditer(source)]
        out += [Route(m[1].upper(), m[2], m[3], *at(m)) for m in _ASPNET_MAP.finditer(source)]
    return out


def rows(path: str, language: str, source: str, manifest: str, symbols: list[dict]) -> list[dict]:
    """Route rows of a file: framework, verb, path, handler name and, where the file declares it, handler id."""
    found = []
    callable_ = sorted((s for s in symbols if s["kind"] in ("function", "method")), key=lambda s: (s["start_line"], s["start_col"]))
    for framework in fired(language, manifest):
        for r in detect(framework, source):
            if r.handler:
                here = sorted(s["id"] for s in callable_ if s["name"] == r.handler)
                handler = here[0] if here else ""
            else:
                handler = next((s["id"] for s in callable_ if (s["start_line"], s["start_col"]) > (r.line, r.col)), "")
            if r.handler or handler:
                found.append(
                    dict(framework=framework, file=path, language=language, verb=r.verb, route=r.path, handler=r.handler, handler_id=handler, line=r.line, col=r.col)
                )
    return found
