"""Word files: literals in the text of their parts give way; what can run or hide refuses."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, unescape

from ..errors import Refused
from .formats import Matcher

# Parts that must be there, parts that are rewritten, markers of active content.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
TEXT_PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml|docProps/(core|app)\.xml")
ACTIVE = ("vbaproject", "activex", "embeddings/", "oleobject", "externallinks", "attachedtoolbars")


def docx_file(data: bytes, m: Matcher) -> tuple[bytes, int]:
    """(bytes, replacements); a literal that formatting splits over text nodes refuses rather than stays."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        names = package.namelist()
        parts = {n: package.read(n) for n in names}
    except (zipfile.BadZipFile, RuntimeError, KeyError):
        raise Refused("docx") from None
    if any(r not in parts for r in REQUIRED) or len(set(names)) < len(names):
        raise Refused("docx-parts")
    if any(a in n.lower() for n in names for a in ACTIVE) or b'TargetMode="External"' in b"".join(v for n, v in parts.items() if n.endswith(".rels")):
        raise Refused("docx-active")
    total = 0
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for name in names:
            content = parts[name]
            if TEXT_PARTS.fullmatch(name):
                xml = content.decode("utf-8")

                def node(x: re.Match) -> str:
                    nonlocal total
                    new, n = m.replace(unescape(x[2], {"&quot;": '"', "&apos;": "'"}))
                    total += n
                    return x[1] + (escape(new) if n else x[2]) + x[3]

                xml = re.sub(r"(>)([^<>]+)(<)", node, xml)
                if m.holds(unescape(re.sub(r"<[^>]*>", "", xml), {"&quot;": '"', "&apos;": "'"})):
                    raise Refused("docx-split-literal")
                content = xml.encode()
            elif m.holds(content.decode("latin-1")):
                raise Refused("docx-part")
            to.writestr(name, content)
    if not total:
        raise Refused("nothing-found")
    return out.getvalue(), total


# What types of relationships and content can run or reach out by, and what a document's must be.
ACTIVE_TYPES = ("vbaproject", "macroenabled", "activex", "oleobject", "/control", "attachedtemplate", "externallink", "afchunk", "subdocument", "package")
DOCUMENT_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
DOCUMENT_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"


def _xml(content: bytes) -> ElementTree.Element:
    """A part's tree; declarations of document types, which may define entities, refuse."""
    if b"<!DOCTYPE" in content[:4096].upper() or b"<!ENTITY" in content.upper():
        raise Refused("docx-xml")
    try:
        return ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError):
        raise Refused("docx-xml") from None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _relations(parts: dict[str, bytes], part: str) -> list[tuple[str, str]]:
    """(type, target part) of a part's relationships, or the package's (an empty name)."""
    folder, name = posixpath.split(part)
    at = posixpath.join(folder, "_rels", f"{name}.rels")
    if at not in parts:
        return []
    tree, out = _xml(parts[at]), []
    if _local(tree.tag) != "Relationships":
        raise Refused("docx-relationships")
    for r in tree:
        kind, target = r.get("Type", ""), r.get("Target", "")
        if r.get("TargetMode", "").lower() == "external" or any(a in kind.lower() for a in ACTIVE_TYPES):
            raise Refused("docx-active")
        to = posixpath.normpath(posixpath.join("/", folder, target)).lstrip("/")
        if to not in parts:
            raise Refused("docx-relationships")
        out.append((kind, to))
    return out


def verified(data: bytes, m: Matcher) -> dict[str, int]:
    """Counts of what was looked at in a package that is whole, passive and holds no literal; refuses any other.

    From the package's relationships the graph of parts is walked; every part must be reached by it, be of a content type that is declared
    and can't run, and hold no literal in bytes, decoded text, names or comments."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        infos = package.infolist()
        parts = {i.filename: package.read(i) for i in infos}
    except (zipfile.BadZipFile, RuntimeError, KeyError):
        raise Refused("docx") from None
    if any(r not in parts for r in REQUIRED) or len(parts) < len(infos):
        raise Refused("docx-parts")
    if any(m.holds(x.decode("utf-8", "ignore")) for x in (package.comment, *(c for i in infos for c in (i.filename.encode(), i.comment, i.extra)))):
        raise Refused("docx-literal-left")
    if any(a in n.lower() for n in parts for a in ACTIVE):
        raise Refused("docx-active")
    types = _xml(parts["[Content_Types].xml"])
    if _local(types.tag) != "Types":
        raise Refused("docx-types")
    by_name = {t.get("PartName", "").lstrip("/"): t.get("ContentType", "") for t in types if _local(t.tag) == "Override"}
    by_suffix = {t.get("Extension", "").lower(): t.get("ContentType", "") for t in types if _local(t.tag) == "Default"}
    if any(a in t.lower() for t in (*by_name.values(), *by_suffix.values()) for a in ACTIVE_TYPES if a != "package") or by_name.get("word/document.xml") != DOCUMENT_TYPE:
        raise Refused("docx-types")
    if (DOCUMENT_RELATION, "word/document.xml") not in _relations(parts, ""):
        raise Refused("docx-relationships")
    reached, todo = {"", "[Content_Types].xml"}, [""]
    while todo:
        part = todo.pop()
        for _, to in _relations(parts, part):
            if to not in reached:
                reached.add(to)
                todo.append(to)
    rels = {posixpath.join(posixpath.dirname(p), "_rels", posixpath.basename(p) + ".rels") for p in reached}
    if any(n not in reached | rels and not n.endswith("/") for n in parts):
        raise Refused("docx-orphan")
    counts = {"parts": len(parts), "xml_parts": 0, "relationships": sum(len(_relations(parts, p)) for p in reached)}
    for name, content in parts.items():
        if name in reached and name not in by_name and posixpath.splitext(name)[1].lstrip(".").lower() not in by_suffix and name != "[Content_Types].xml":
            raise Refused("docx-types")
        if m.holds(content.decode("utf-8", "ignore")):
            raise Refused("docx-literal-left")
        if name.endswith((".xml", ".rels")):
            tree = _xml(content)
            counts["xml_parts"] += 1
            values = [v for e in tree.iter() for v in (*e.attrib.values(), e.text or "", e.tail or "")]
            if any(map(m.holds, values)) or m.holds("".join(tree.itertext())):
                raise Refused("docx-literal-left")
            if name == "word/document.xml" and (_local(tree.tag) != "document" or not any(_local(e.tag) == "body" for e in tree)):
                raise Refused("docx-body")
    return counts
