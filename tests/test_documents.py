import io
import zipfile

import pytest

from umbra.errors import Refused
from umbra.operators import policy
from umbra.sources import dicom, office
from umbra.sources.formats import Matcher

M = Matcher(policy.compiled({"version": 1, "sensitive_values": [{"rule_id": "a", "type": "name", "value": "Mara & Co"}], "protected_values": []}))


def docx(body, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in {"[Content_Types].xml": "<t/>", "_rels/.rels": "<r/>", "word/document.xml": body, **more}.items():
            z.writestr(n, x)
    return out.getvalue()


def test_docx():
    data, n = office.docx_file(docx("<w:t>by Mara &amp; Co</w:t>"), M)
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    assert n == 1 and "Person-" in xml and "Mara" not in xml
    for bad, code in ((docx("<w:t>Mara </w:t><w:t>&amp; Co</w:t>"), "docx-split-literal"), (docx("<w:t>x</w:t>"), "nothing-found"), (docx("<a/>", **{"word/vbaProject.bin": "x"}), "docx-active"), (b"no", "docx")):
        with pytest.raises(Refused) as e:
            office.docx_file(bad, M)
        assert e.value.code == code


def test_dicom():
    e = [dicom.Element(2, 0x10, b"UI", dicom.EXPLICIT_LITTLE + b"\0"), dicom.Element(0x10, 0x10, b"PN", b"Mara & Co "), dicom.Element(0x7FE0, 0x10, b"OW", b"\1\2")]
    data = b"\0" * 128 + b"DICM" + b"".join(map(dicom.written, e))
    new, n = dicom.dicom_file(data, M)
    got = list(dicom.elements(new))
    assert n == 1 and got[1].value.startswith(b"Person-") and len(got[1].value) % 2 == 0 and got[2] == e[2]
    with pytest.raises(Refused):
        list(dicom.elements(data[:-1]))


def whole(body="<w:t>by Mara &amp; Co</w:t>", types="", rels="", document_rels=None, **more):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    parts = {
        "[Content_Types].xml": f'<Types><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{office.DOCUMENT_TYPE}"/>{types}</Types>',
        "_rels/.rels": f'<Relationships><Relationship Id="r1" Type="{office.DOCUMENT_RELATION}" Target="word/document.xml"/>{rels}</Relationships>',
        "word/document.xml": f"<w:document {w}><w:body><w:p><w:r>{body}</w:r></w:p></w:body></w:document>",
    }
    if document_rels is not None:
        parts["word/_rels/document.xml.rels"] = f"<Relationships>{document_rels}</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in (parts | more).items():
            if x is not None:
                z.writestr(n, x)
    return out.getvalue()


STYLES = {"word/styles.xml": "<s/>"}
STYLE = '<Relationship Id="r2" Type="http://x/styles" Target="styles.xml"/>'


@pytest.mark.parametrize("data, code", [
    (whole("<w:t>x</w:t>"), None),
    (whole("<w:t>x</w:t>", document_rels=STYLE, **STYLES), None),
    (whole("<w:t>x</w:t>", **STYLES), "docx-orphan"),
    (whole("<w:t>x</w:t>", document_rels=STYLE), "docx-relationships"),
    (whole("<w:t>x</w:t>", document_rels=STYLE.replace("styles.xml", "http://x/y") .replace("/>", ' TargetMode="External"/>')), "docx-active"),
    (whole("<w:t>x</w:t>", document_rels=STYLE.replace("/styles", "/attachedTemplate"), **STYLES), "docx-active"),
    (whole("<w:t>x</w:t>", types='<Override PartName="/x" ContentType="application/vnd.ms-office.vbaProject"/>'), "docx-types"),
    (whole("<w:t>x</w:t>", **{"word/document.xml": "<w/>"}), "docx-body"),
    (whole("<w:t>x</w:t>", **{"word/document.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><w/>"}), "docx-xml"),
    (whole("<w:t>x</w:t>", **{"_rels/.rels": "<Relationships/>"}), "docx-relationships"),
    (whole("<w:t>x</w:t>", **{"_rels/.rels": None}), "docx-parts"),
    (whole("<w:t>Mara </w:t><w:t>&amp; Co</w:t>"), "docx-literal-left"),
    (whole("<w:t a='Mara &#38; Co'>x</w:t>"), "docx-literal-left"),
    (whole("<w:t>x</w:t>", document_rels=STYLE, **{"word/styles.xml": "<s>Mara &#x26; Co</s>"}), "docx-literal-left"),
])
def test_docx_structure(data, code):
    if code is None:
        assert office.verified(data, M)["xml_parts"] >= 3
        return
    with pytest.raises(Refused) as e:
        office.verified(data, M)
    assert e.value.code == code


def dicom_of(syntax, found, s):
    head = [dicom.Element(2, 0, b"UL", b"\0" * 4), dicom.Element(2, 0x10, b"UI", syntax + b"\0" * (len(syntax) % 2)), dicom.Element(2, 0x16, b"AE", b"Mara & Co ")]
    head = dicom._grouped(head, [dicom._META] * 3)
    return b"\0" * 128 + b"DICM" + b"".join(map(dicom.written, head)) + b"".join(dicom.written(e, s) for e in found)


@pytest.mark.parametrize("syntax, order, explicit", [(dicom.EXPLICIT_LITTLE, "little", True), (dicom.IMPLICIT_LITTLE, "little", False), (dicom.EXPLICIT_BIG, "big", True)])
def test_dicom_trees(syntax, order, explicit):
    name = dicom.Element(0x10, 0x10, b"PN", b"Mara & Co ")
    deep = dicom.Element(8, 0x1111, b"SQ", items=(dicom.Item((name, dicom.Element(8, 0x50, b"SH", b"x "))), dicom.Item((name,), True), dicom.Item(())), undefined=True)
    nested = dicom.Element(8, 0x1140, b"SQ", items=(dicom.Item((deep,)),), undefined=not explicit)
    pixels = dicom.Element(0x7FE0, 0x10, b"OW" if not explicit else b"OB", items=(dicom.Item(b""), dicom.Item(b"\1\2\3\4")), undefined=True)
    s = dicom._Syntax(order, explicit)
    found = [nested, name, pixels] if explicit else [dicom.Element(8, 0x1140, b"UN", items=(dicom.Item((dicom.Element(8, 0x1111, b"UN", items=deep.items, undefined=True),)),), undefined=True), name, pixels]
    data = dicom_of(syntax, found, s)
    again = dicom.parsed(data)
    assert data[:132] + b"".join(dicom.written(e, x) for e, x in again) == data and [e for e, _ in again][3:] == found
    new, n = dicom.dicom_file(data, M)
    assert n == 4 and b"Mara" not in new and dicom.verified(new, M)["text_elements"] == 6
    group = next(e for e in dicom.elements(new) if (e.group, e.element) == (2, 0))
    first = next(i for i in range(len(new)) if new[i : i + 4] == b"\2\0\x10\0")
    assert new[first + int.from_bytes(group.value, "little") :][:2] == (8).to_bytes(2, order)
    for cut in (data[:-3], data[:200], data.replace(b"DICM", b"DICX")):
        with pytest.raises(Refused):
            dicom.dicom_file(cut, M)
    with pytest.raises(Refused, match="dicom-binary"):
        dicom.dicom_file(data + dicom.written(dicom.Element(0x11, 0x10, b"UN", b"Mara & Co "), s), M)
    endless = dicom.Element(8, 0x1140, b"SQ" if explicit else b"UN", items=(), undefined=True)
    for _ in range(80):
        endless = dicom.Element(8, 0x1140, endless.vr, items=(dicom.Item((endless,)),), undefined=True)
    with pytest.raises(Refused, match="dicom-depth"):
        list(dicom.elements(dicom_of(syntax, [endless], s)))


def test_redact_document(spark, tmp_path):
    import json
    import stat

    from umbra import documents

    at = lambda n: str(tmp_path / n)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(whole())
    (tmp_path / "in" / "b.dcm").write_bytes(dicom_of(dicom.EXPLICIT_LITTLE, [], dicom._META))
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "sensitive_values": [{"rule_id": "a", "type": "name", "value": "Mara & Co"}], "protected_values": []}))
    got = documents.redact(at("in/a.docx"), at("p.json"), at("out.docx"), at("r.json"))
    assert got == json.loads((tmp_path / "r.json").read_text()) and got["replacements"] == 1 and stat.S_IMODE((tmp_path / "r.json").stat().st_mode) == 0o600
    with pytest.raises(Refused, match="output-exists"):
        documents.redact(at("in/a.docx"), at("p.json"), at("out.docx"), at("r2.json"))
    with pytest.raises(Refused, match="docx-orphan"):
        (tmp_path / "bad.docx").write_bytes(whole(**STYLES))
        documents.redact(at("bad.docx"), at("p.json"), at("bad2.docx"), at("r3.json"))
    assert not {"bad2.docx", "r2.json", "r3.json"} & {p.name for p in tmp_path.iterdir()}
    rows = {r["path"].rsplit("/", 1)[1]: (r["replacements"], r["code"]) for r in documents.folder(spark, at("in"), policy.load(at("p.json"))).collect()}
    assert rows == {"a.docx": (1, None), "b.dcm": (1, None), "c.pdf": (0, "document-kind")}
