"""The PDF reader on files made here."""

import base64
import zlib

import pytest

from weftline.sources import pages, pdf

LINES = ["Sample paragraph one about artificial intelligence.", "Sample paragraph two about knowledge graphs."]


def made(objects, *, wrap=lambda b: (b"", b)):
    """A file of numbered objects; streams are (dictionary, bytes)."""
    out = b"%PDF-1.4\n"
    for n, o in objects.items():
        if isinstance(o, tuple):
            head, body = wrap(o[1]) if o[0] == b"" else (o[0], o[1])
            o = b"<< " + head + b" /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream"
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def simple(content, **how):
    return made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: (b"", content), 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}, **how)


DRAWN = b"BT 1 0 0 1 100 750 Tm /F1 12 Tf 14.4 TL (%s) Tj T* ET\nBT 1 0 0 1 100 700 Tm (%s) Tj T* ET" % tuple(x.encode() for x in LINES)


@pytest.mark.parametrize("wrap", [
    lambda b: (b"", b),
    lambda b: (b"/Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(b)) + b"~>"),
    lambda b: (b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>", zlib.compress(b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(r, q)) for q, r in zip([bytes(16), *(b.ljust(-(-len(b) // 16) * 16)[i : i + 16] for i in range(0, len(b), 16))], (b.ljust(-(-len(b) // 16) * 16)[i : i + 16] for i in range(0, len(b), 16)))))),
    lambda b: (b"/Filter /ASCIIHexDecode", b.hex().encode() + b">"),
])
def test_two_lines(wrap):
    assert pdf.page_texts(simple(DRAWN, wrap=wrap)) == ["\n".join(LINES)]


def test_object_streams_and_unicode_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <D83DDE00>] endbfrange"
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 8 0 R] >>", 3: b"<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F1 5 0 R >> >> >>", 8: b"<< /Type /Page /Contents 9 0 R /Resources << /Font << /F2 6 0 R >> >> >>", 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", 6: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /uni0416 /fi] >> >>"}
    heads, body = [], b""
    for n, o in packed.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    first = b" ".join(heads) + b" "
    stream = zlib.compress(first + body)
    file = made({20: (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(packed), len(first)), stream), 4: (b"", b"BT /F1 9 Tf [<001000110012> -300 <0020>] TJ 0 -12 Td <00030021> Tj ET"), 7: (b"", cmap), 9: (b"", b"BT /F2 9 Tf (BC x\\(y\\)\\101) Tj ET")})
    assert pdf.page_texts(file) == ["abc é\n 😀", "Жfi x(y)"]


def test_broken_files():
    whole = simple(DRAWN, wrap=lambda b: (b"/Filter /FlateDecode", zlib.compress(b)))
    assert pdf.page_texts(whole.replace(b"/Length", b"/Longth")) == ["\n".join(LINES)]  # the end is found
    for cut in range(0, len(whole), 37):  # a cut file gives what is there or is refused
        try:
            assert isinstance(pdf.page_texts(whole[:cut]), list)
        except ValueError as e:
            assert "no PDF pages" in str(e)
    with pytest.raises(ValueError, match="no PDF pages"):
        pdf.page_texts(b"no PDF")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.page_texts(whole.replace(b"trailer << ", b"trailer << /Encrypt 9 0 R "))
    looped = made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 3 0 R >>"})
    assert pdf.page_texts(looped) == [""]


def test_load_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(simple(DRAWN))
    got = pages.load_pdf(spark, str(tmp_path)).collect()
    assert [(r.filename, r.pages, r.page_start, r.page_end, r.text) for r in got] == [("a.pdf", 1, 1, 1, "\n".join(LINES))] and len(got[0].doc_hash) == 64
