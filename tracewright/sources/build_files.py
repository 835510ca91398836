"""Readers of build files and installed packages, used by the manifests module: each takes a text and gives name, version, requirement and line.

A version is one that the file fixes; ranges, wildcards and properties that the file doesn't define give null. A text of another form raises ValueError or gives nothing.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from xml.parsers import expat

from packaging.requirements import InvalidRequirement, Requirement

Found = Iterator[tuple[str, str | None, str, int]]

#: Configurations of Gradle, and keys of a table that stand for sources outside the registry.
GRADLE = "api|implementation|compileOnly|compileOnlyApi|runtimeOnly|annotationProcessor|kapt|ksp|testImplementation|testCompileOnly|testRuntimeOnly|androidTestImplementation|debugImplementation|releaseImplementation|compile|runtime|testCompile|classpath"
LOCAL = {"path", "git", "url", "file"}


def _line(text: str, part: str) -> int:
    """The line on which part stands first, from 1; 1 if it stands nowhere."""
    return text.count("\n", 0, max(0, text.find(part))) + 1


def _pinned(wanted: str) -> str | None:
    """The version of a specifier such as ==1.0, if that is all it says."""
    m = re.fullmatch(r"={2,3}\s*([^\s,*]+)", wanted.strip())
    return m and m[1]


def _specifier(text: str, spec: object) -> Found:
    if isinstance(spec, str):
        try:
            own = Requirement(spec)
        except InvalidRequirement:
            return
        yield own.name, _pinned(str(own.specifier)), str(own.specifier), _line(text, spec)


def _named(text: str, table: dict) -> Found:
    """A table of names to a version or to a table that holds one. Poetry's bare version means a range, so it fixes nothing."""
    for name, spec in table.items():
        if isinstance(spec, dict):
            if LOCAL & set(spec):
                continue
            spec = spec.get("version", "*")
        if isinstance(spec, str) and name.lower() != "python":
            m = re.search(rf"(?m)^\s*[\"']?{re.escape(name)}[\"']?\s*=", text)
            yield name, _pinned(spec), spec, text.count("\n", 0, m.end()) + 1 if m else 1


def pyproject(text: str) -> Found:
    root = tomllib.loads(text)
    project = root.get("project", {})
    lists = [project.get("dependencies", []), *project.get("optional-dependencies", {}).values(), *root.get("dependency-groups", {}).values(), root.get("build-system", {}).get("requires", [])]
    for specs in lists:
        for spec in specs:
            yield from _specifier(text, spec)
    poetry = root.get("tool", {}).get("poetry", {})
    for table in (poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())):
        yield from _named(text, table)


def pipfile(text: str) -> Found:
    root = tomllib.loads(text)
    for group in ("packages", "dev-packages"):
        yield from _named(text, root.get(group, {}))


def metadata(text: str) -> Found:
    """The one package that an installed distribution's METADATA names."""
    head = text.partition("\n\n")[0]
    own = {k.lower(): v.strip() for k, v in re.findall(r"(?m)^(Name|Version):(.*)$", head)}
    if {"name", "version"} <= set(own):
        yield own["name"], own["version"], own["version"], _line(head, "Name:")


def pnpm_lock(text: str) -> Found:
    """Keys of the section packages: /name/1.0.0, /name@1.0.0(peer) or 'name@1.0.0', as the versions of the format have them."""
    section = re.search(r"(?m)^packages:[ \t]*\n((?:[ \t]+[^\n]*\n?|[ \t]*\n)*)", text)
    for m in re.finditer(r"(?m)^  ['\"]?/?((?:@[^/@\s'\"]+/)?[^/@\s'\"]+)[@/](\d+\.\d+\.\d+[^\s:'\"()_]*)[^\n]*:", section[1] if section else ""):
        yield m[1], m[2], m[2], text.count("\n", 0, section.start(1) + m.start()) + 1


def _elements(text: str) -> list[tuple[tuple[str, ...], dict[str, str], str, int]]:
    """Path, attributes, text and line of each element, a parent after its children. Documents that define entities aren't read."""
    if "<!DOCTYPE" in text:
        raise ValueError("a document type isn't read")
    out, path, open_up = [], [], []
    parser = expat.ParserCreate()

    def start(name: str, attributes: dict[str, str]) -> None:
        path.append(name.rpartition(":")[2])
        open_up.append((attributes, [], parser.CurrentLineNumber))

    def end(_: str) -> None:
        attributes, parts, line = open_up.pop()
        out.append((tuple(path), attributes, "".join(parts).strip(), line))
        path.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: open_up[-1][1].append(data)
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    return out


def pom(text: str) -> Found:
    """Dependencies, managed ones too, with properties of the file put in; those of plugins are left out."""
    elements = _elements(text)
    known = {f"project.{p[-1]}": t for p, _, t, _ in elements if len(p) == 2 and p[-1] in ("version", "groupId", "artifactId")}
    known |= {f"project.parent.{p[-1]}": t for p, _, t, _ in elements if p[:-1] == ("project", "parent")}
    known |= {p[-1]: t for p, _, t, _ in elements if p[-2:-1] == ("properties",)}
    known |= {f"project.{k}": known[f"project.parent.{k}"] for k in ("version", "groupId") if f"project.{k}" not in known and f"project.parent.{k}" in known}

    def put_in(value: str) -> str:
        for _ in range(5):  # properties may name others
            value = re.sub(r"\$\{([^}]*)\}", lambda m: known.get(m[1], m[0]), value)
        return value

    own: dict[str, str] = {}
    for path, _, value, line in elements:
        if path[-2:-1] == ("dependency",):
            own[path[-1]] = value
        elif path[-1] == "dependency":
            if {"groupId", "artifactId"} <= set(own) and "plugin" not in path:
                version = put_in(own.get("version", ""))
                fixed = re.fullmatch(r"\[?([^\[\](),$\s]+)\]?", version)
                yield f"{put_in(own['groupId'])}:{put_in(own['artifactId'])}", fixed and fixed[1], own.get("version", ""), line
            own = {}


def gradle(text: str) -> Found:
    """Coordinates as one string, or as named parts; comments are left out. Variables in a version give null."""
    bare = re.sub(r"(?m)/\*.*?\*/|^\s*//[^\n]*", lambda m: "\n" * m[0].count("\n"), text, flags=re.DOTALL)
    bare = re.sub(r"(?m)(?<=\s)//[^\n]*", "", bare)
    one = rf"\b(?:{GRADLE})\b\s*\(?\s*(?:platform\s*\(|enforcedPlatform\s*\()?\s*"
    for m in re.finditer(one + r"""["']([^:"'\s]+):([^:"'\s]+)(?::([^:"'@\s]+))?[^"'\n]*["']""", bare):
        yield f"{m[1]}:{m[2]}", _gradle_version(m[3] or ""), m[3] or "", bare.count("\n", 0, m.start()) + 1
    for m in re.finditer(one + r"""((?:\w+\s*[:=]\s*["'][^"'\n]*["']\s*,?\s*)+)""", bare):
        own = dict(re.findall(r"""(\w+)\s*[:=]\s*["']([^"'\n]*)["']""", m[1]))
        if {"group", "name"} <= set(own):
            yield f"{own['group']}:{own['name']}", _gradle_version(own.get("version", "")), own.get("version", ""), bare.count("\n", 0, m.start()) + 1


def _gradle_version(version: str) -> str | None:
    return None if not version or set(version) & set("$+[](),") or version.startswith("latest.") else version.removesuffix("!!")


def msbuild(text: str) -> Found:
    """PackageReference and PackageVersion items, the version an attribute or a child."""
    child = ""
    for path, attributes, value, line in _elements(text):
        if path[-2:-1] in (("PackageReference",), ("PackageVersion",)) and path[-1] in ("Version", "VersionOverride"):
            child = value
        elif path[-1] in ("PackageReference", "PackageVersion"):
            name = attributes.get("Include") or attributes.get("Update") or ""
            wanted, child = attributes.get("VersionOverride") or attributes.get("Version") or child, ""
            fixed = re.fullmatch(r"\[?([^\[\](),$*\s]+)\]?", wanted)
            if name and "$" not in name:
                yield name, fixed and fixed[1], wanted, line
