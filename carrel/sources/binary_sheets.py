"""The binary spreadsheet formats: xls (BIFF8 records in a compound file) and xlsb (binary records in a zip archive), read and written after Microsoft's open specifications.

Both give and take ``Sheets`` of texts. What is written are text cells. Workbooks of Excel 5 and older, and encrypted ones, raise.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

Sheets = list[tuple[str, list[list[str | None]]]]
#: The first bytes of a compound file, and the marks of its sectors.
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
SECTOR = 512
#: The largest sheet of an xls, and the most bytes of one of its records.
XLS_ROWS, XLS_COLUMNS, XLS_RECORD = 65536, 256, 8224
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def put(rows: list[list[str | None]], r: int, c: int, value: str | None) -> None:
    """Sets a cell of a sheet that grows as needed."""
    rows += [[] for _ in range(r + 1 - len(rows))]
    rows[r] += [None] * (c + 1 - len(rows[r]))
    rows[r][c] = value


def rk_number(rk: int) -> float:
    """A number in the 30-bit form of both formats."""
    x = (rk >> 2) - (1 << 30 if rk & 0x80000000 else 0) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return x / 100 if rk & 1 else float(x)


# --- compound files ----------------------------------------------------------------------------------------------------------------------------
def compound_stream(data: bytes, *names: str) -> bytes | None:
    """The first stream of a compound file that has one of the names."""
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir = struct.unpack_from("<II", data, 44)
    cutoff, first_mini, _, at = struct.unpack_from("<IIII", data, 56)
    size = 1 << shift
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])
    fat_sectors = list(numbers(data[76:512]))
    seen = set()
    while at not in (END, FREE) and at not in seen:
        seen.add(at)
        *more, at = numbers(sector(at))
        fat_sectors += more
    fat = [x for s in fat_sectors[:n_fat] if s < DIFAT for x in numbers(sector(s))]

    def chain(n: int, table: list[int] | tuple[int, ...], part: Callable[[int], bytes]) -> bytes:
        out, known = [], set()
        while n < DIFAT and n < len(table) and n not in known:
            known.add(n)
            out.append(part(n))
            n = table[n]
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    found, root = {}, b""
    for at in range(0, len(entries) - 127, 128):
        n, kind = struct.unpack_from("<HB", entries, at + 64)
        start, length = struct.unpack_from("<IQ", entries, at + 116)
        name = entries[at : at + max(0, n - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            root = chain(start, fat, sector)
        elif kind == 2:
            found[name] = (start, length & 0xFFFFFFFF)
    for name in names:
        if name in found:
            start, length = found[name]
            if length >= cutoff:
                return chain(start, fat, sector)[:length]
            small = 1 << mini_shift
            return chain(start, numbers(chain(first_mini, fat, sector)), lambda n: root[n * small : (n + 1) * small])[:length]
    return None


def compound_file(name: str, stream: bytes) -> bytes:
    """A compound file of one stream."""
    stream += b"\0" * (max(4096, -(-len(stream) // SECTOR) * SECTOR) - len(stream))
    n = len(stream) // SECTOR
    per, more = SECTOR // 4, SECTOR // 4 - 1
    n_fat = n_difat = 0
    while True:  # sectors: stream, directory, FAT, DIFAT
        need = -(-(n + 1 + n_fat + n_difat) // per)
        difat = max(0, -(-(need - 109) // more))
        if (need, difat) == (n_fat, n_difat):
            break
        n_fat, n_difat = need, difat
    fat_at, difat_at = n + 1, n + 1 + n_fat
    fat = [*range(1, n), END, END, *[FAT] * n_fat, *[DIFAT] * n_difat]
    fat += [FREE] * (n_fat * per - len(fat))
    places = list(range(fat_at, fat_at + n_fat))
    head = COMPOUND + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, n, 0, 4096, END, 0, difat_at if n_difat else END, n_difat)
    head += struct.pack("<109I", *(places[:109] + [FREE] * (109 - len(places[:109]))))

    def entry(title: str, kind: int, child: int, start: int, length: int) -> bytes:
        raw = title.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(raw), kind, 1, FREE, FREE, child, start, length)

    folder = entry("Root Entry", 5, 1, END, 0) + entry(name, 2, FREE, 0, len(stream)) + 2 * (b"\0" * 68 + struct.pack("<III48x", FREE, FREE, FREE))
    chained = b""
    for i in range(n_difat):
        part = places[109 + i * more : 109 + (i + 1) * more]
        chained += struct.pack(f"<{per}I", *part, *[FREE] * (more - len(part)), difat_at + i + 1 if i + 1 < n_difat else END)
    return head + stream + folder + struct.pack(f"<{len(fat)}I", *fat) + chained


# --- xls ---------------------------------------------------------------------------------------------------------------------------------------
def biff(data: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """(record type, its data and that of the records that continue it)."""
    kind, parts = -1, []
    while at + 4 <= len(data):
        k, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if k == 0x3C and kind >= 0:
            parts.append(body)
            continue
        if kind >= 0:
            yield kind, parts
        kind, parts = k, [body]
        if k == 0x0A:
            break
    if kind >= 0:
        yield kind, parts


class Parts:
    """Reads strings that may run over the ends of continued records; characters then go on after a byte that tells their width."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.i, self.at = parts, 0, at

    def room(self) -> int:
        while self.i < len(self.parts) and self.at >= len(self.parts[self.i]):
            self.i, self.at = self.i + 1, 0
        return len(self.parts[self.i]) - self.at if self.i < len(self.parts) else 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.room():
            part = self.parts[self.i][self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out += part
        return out

    def string(self, long: bool = True) -> str:
        n = int.from_bytes(self.take(2 if long else 1), "little")
        flags = self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out, wide = "", flags & 1
        while n and self.room():
            if self.at == 0 and self.i:  # in a continued record
                wide = self.take(1)[0] & 1
            part = self.take(min(n * (1 + wide), self.room()))
            out += part.decode("utf-16-le" if wide else "latin-1", "surrogatepass" if wide else "strict")
            n -= len(part) // (1 + wide)
        self.take(4 * runs + extra)
        return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def xls_sheets(data: bytes, shown: Callable[[float, bool], str], is_date: Callable[[int, str | None], bool]) -> Sheets:
    """shown: the text of a number, which is a date or not; is_date: whether a number format (its place, its own pattern) is one of dates."""
    book = compound_stream(data, "Workbook")
    if book is None:
        raise ValueError("not a workbook of Excel 97 or later")
    places, strings, formats, styles, days = [], [], {}, [], 0
    for kind, parts in biff(book, 0):
        body = parts[0]
        if kind == 0x2F:
            raise ValueError("the workbook is encrypted")
        if kind == 0x85 and body[5] == 0:  # a sheet of cells
            places.append((struct.unpack_from("<I", body)[0], Parts([body], 6).string(False)))
        elif kind == 0xFC:
            p = Parts(parts, 8)
            strings = [p.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == 0x041E:
            formats[struct.unpack_from("<H", body)[0]] = Parts(parts, 2).string()
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x22 and body[:2] == b"\1\0":
            days = 1462
    dates = {i for i, f in enumerate(styles) if is_date(f, formats.get(f))}
    number = lambda x, style: shown(x + days, True) if style in dates else shown(x, False)
    out: Sheets = []
    for at, name in places:
        rows: list[list[str | None]] = []
        waits = None
        for kind, parts in biff(book, at):
            b = parts[0]
            if kind == 0x0207 and waits:
                put(rows, *waits, Parts(parts).string())
                waits = None
                continue
            if kind not in (0x0203, 0x027E, 0xBD, 0xFD, 0x0204, 0xD6, 0x0205, 0x06):
                continue
            r, c, style = struct.unpack_from("<HHH", b)
            if kind == 0x0203:
                put(rows, r, c, number(struct.unpack_from("<d", b, 6)[0], style))
            elif kind == 0x027E:
                put(rows, r, c, number(rk_number(struct.unpack_from("<I", b, 6)[0]), style))
            elif kind == 0xBD:
                for k in range((len(b) - 6) // 6):
                    style, rk = struct.unpack_from("<HI", b, 4 + 6 * k)
                    put(rows, r, c + k, number(rk_number(rk), style))
            elif kind == 0xFD:
                put(rows, r, c, strings[struct.unpack_from("<I", b, 6)[0]])
            elif kind in (0x0204, 0xD6):
                put(rows, r, c, Parts(parts, 6).string())
            elif kind == 0x0205:
                put(rows, r, c, ERRORS.get(b[6], "#N/A") if b[7] else "true" if b[6] else "false")
            elif b[12:14] != b"\xff\xff":
                put(rows, r, c, number(struct.unpack_from("<d", b, 6)[0], style))
            elif b[6] == 0:
                waits = (r, c)
            elif b[6] in (1, 2):
                put(rows, r, c, ("true" if b[8] else "false") if b[6] == 1 else ERRORS.get(b[8], "#N/A"))
        out.append((name, rows))
    return out


def xls_bytes(book: Sheets) -> bytes:
    """An xls of text cells; a sheet of more rows or columns than the format has raises."""
    record = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    places: dict[str, int] = {}
    total = 0
    for name, rows in book:
        if len(rows) > XLS_ROWS or any(len(r) > XLS_COLUMNS for r in rows):
            raise ValueError(f"{name}: an xls has {XLS_ROWS} rows and {XLS_COLUMNS} columns at most")
        for row in rows:
            for v in row:
                if v is not None:
                    total += 1
                    places.setdefault(v, len(places))
    table, part = [], struct.pack("<II", total, len(places))
    for text in places:
        raw = text.encode("utf-16-le", "surrogatepass")
        if len(raw) > 2 * 32767:
            raise ValueError("a cell of an xls has 32767 characters at most")
        if XLS_RECORD - len(part) < 5:
            table.append(part)
            part = b""
        part += struct.pack("<HB", len(raw) // 2, 1)
        while raw:
            room = (XLS_RECORD - len(part)) // 2 * 2
            part, raw = part + raw[:room], raw[room:]
            if raw:
                table.append(part)
                part = b"\1"
    table.append(part)
    start = lambda kind: record(0x0809, struct.pack("<HHHHII", 0x0600, kind, 0x0DBB, 0x07CC, 0, 6))
    font = record(0x31, struct.pack("<HHHHHBBBB", 200, 0, 0x7FFF, 400, 0, 0, 0, 0, 0) + b"\5\0Arial")
    style = lambda kind: record(0xE0, struct.pack("<HHHBBBBIIH", 0, 0, kind, 0x20, 0, 0, 0, 0, 0, 0x20C0))
    head = start(5) + record(0x42, struct.pack("<H", 1200)) + record(0x3D, struct.pack("<9H", 0, 0, 0x3000, 0x2000, 0x38, 0, 0, 1, 600)) + 4 * font + 15 * style(0xFFF5) + style(1)
    head += record(0x0293, struct.pack("<HBB", 0x8000, 0, 0xFF))
    names = [raw for name, _ in book for raw in [name.encode("utf-16-le")[:62]]]
    tail = record(0xFC, table[0]) + b"".join(record(0x3C, x) for x in table[1:]) + record(0x0A)
    at = len(head) + sum(12 + len(x) for x in names) + len(tail)
    bound, body = b"", b""
    for raw, (_, rows) in zip(names, book, strict=True):
        bound += record(0x85, struct.pack("<IBBBB", at + len(body), 0, 0, len(raw) // 2, 1) + raw)
        width = max((len(r) for r in rows), default=0)
        body += start(0x10) + record(0x0200, struct.pack("<IIHHH", 0, len(rows), 0, width, 0))
        body += b"".join(record(0xFD, struct.pack("<HHHI", r, c, 15, places[v])) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None)
        body += record(0x023E, struct.pack("<HHHIHHI", 0x06B6, 0, 0, 0x40, 0, 0, 0)) + record(0x0A)
    return compound_file("Workbook", head + bound + tail + body)


# --- xlsb --------------------------------------------------------------------------------------------------------------------------------------
def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80:
            kind = kind & 0x7F | (data[at] & 0x7F) << 7
            at += 1
        n = 0
        for k in range(4):
            b = data[at]
            at += 1
            n |= (b & 0x7F) << 7 * k
            if b < 0x80:
                break
        yield kind, data[at : at + n]
        at += n


def wide(b: bytes, at: int) -> tuple[str, int]:
    """A string at a place, and the place after it."""
    n = struct.unpack_from("<I", b, at)[0]
    n = 0 if n == 0xFFFFFFFF else n
    return b[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_sheets(data: bytes, shown: Callable[[float, bool], str], is_date: Callable[[int, str | None], bool]) -> Sheets:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        part = lambda n: list(records(z.read(n))) if n in names else []
        strings = [wide(b, 1)[0] for kind, b in part("xl/sharedStrings.bin") if kind == 19]
        formats, styles, inside = {}, [], False
        for kind, b in part("xl/styles.bin"):
            if kind == 44:
                formats[struct.unpack_from("<H", b)[0]] = wide(b, 2)[0]
            elif kind in (617, 618):
                inside = kind == 617
            elif kind == 47 and inside:
                styles.append(struct.unpack_from("<H", b, 2)[0])
        dates = {i for i, f in enumerate(styles) if is_date(f, formats.get(f))}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
        sheets, days = [], 0
        for kind, b in part("xl/workbook.bin"):
            if kind == 156:
                ident, at = wide(b, 8)
                sheets.append((wide(b, at)[0], targets[ident].lstrip("/")))
            elif kind == 153 and b[0] & 1:
                days = 1462
        number = lambda x, style: shown(x + days, True) if style in dates else shown(x, False)
        out: Sheets = []
        for name, target in sheets:
            rows: list[list[str | None]] = []
            r = 0
            for kind, b in part(target if target.startswith("xl/") else f"xl/{target}"):
                if kind == 0:
                    r = struct.unpack_from("<I", b)[0]
                    continue
                if not 2 <= kind <= 11:
                    continue
                c, style = struct.unpack_from("<II", b)
                style &= 0xFFFFFF
                if kind == 2:
                    value = number(rk_number(struct.unpack_from("<I", b, 8)[0]), style)
                elif kind in (3, 11):
                    value = ERRORS.get(b[8], "#N/A")
                elif kind in (4, 10):
                    value = "true" if b[8] else "false"
                elif kind in (5, 9):
                    value = number(struct.unpack_from("<d", b, 8)[0], style)
                elif kind == 7:
                    value = strings[struct.unpack_from("<I", b, 8)[0]]
                else:
                    value = wide(b, 8)[0]
                put(rows, r, c, value)
            out.append((name, rows))
        return out


def xlsb_bytes(book: Sheets) -> bytes:
    """An xlsb of text cells."""

    def record(kind: int, body: bytes = b"") -> bytes:
        head = bytes([kind]) if kind < 0x80 else bytes([kind & 0x7F | 0x80, kind >> 7])
        n, size = len(body), b""
        while n >= 0x80:
            size, n = size + bytes([n & 0x7F | 0x80]), n >> 7
        return head + size + bytes([n]) + body

    def text(s: str) -> bytes:
        raw = s.encode("utf-16-le", "surrogatepass")
        return struct.pack("<I", len(raw) // 2) + raw

    out = io.BytesIO()
    kind, rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.bin" ContentType="application/vnd.ms-excel.worksheet"/>' for i in range(len(book)))
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
                   'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="bin" ContentType="application/vnd.ms-excel.sheet.binary.macroEnabled.main"/>'
                   f"{over}</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{rels}"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.bin"/></Relationships>')
        z.writestr("xl/_rels/workbook.bin.rels", f'<?xml version="1.0"?><Relationships xmlns="{rels}">' + "".join(
            f'<Relationship Id="r{i + 1}" Type="{kind}/worksheet" Target="worksheets/sheet{i + 1}.bin"/>' for i in range(len(book))) + "</Relationships>")
        bundle = b"".join(record(156, struct.pack("<II", 0, i + 1) + text(f"r{i + 1}") + text(name)) for i, (name, _) in enumerate(book))
        z.writestr("xl/workbook.bin", record(131) + record(143) + bundle + record(144) + record(132))
        for i, (_, rows) in enumerate(book):
            body = [record(129), record(148, struct.pack("<IIII", 0, max(0, len(rows) - 1), 0, max(0, max((len(r) for r in rows), default=0) - 1))), record(145)]
            for r, row in enumerate(rows):
                body.append(record(0, struct.pack("<IIHHBI", r, 0, 300, 0, 0, 0)))
                body += [record(6, struct.pack("<II", c, 0) + text(v)) for c, v in enumerate(row) if v is not None]
            z.writestr(f"xl/worksheets/sheet{i + 1}.bin", b"".join([*body, record(146), record(130)]))
    return out.getvalue()


# --- ods ---------------------------------------------------------------------------------------------------------------------------------------
def ods_bytes(book: Sheets) -> bytes:
    """An OpenDocument spreadsheet of text cells."""
    doc, mime = "urn:oasis:names:tc:opendocument:xmlns", "application/vnd.oasis.opendocument.spreadsheet"

    def cell(v: str | None) -> str:
        if v is None:
            return "<table:table-cell/>"
        # runs of white space would be read as one space
        spaced = lambda s: re.sub(r"  +", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', escape(s)).replace("\t", "<text:tab/>")
        return '<table:table-cell office:value-type="string">' + "".join(f"<text:p>{spaced(line)}</text:p>" for line in v.split("\n")) + "</table:table-cell>"

    tables = "".join(
        f'<table:table table:name="{escape(name, {chr(34): "&quot;"})}">' + "".join("<table:table-row>" + "".join(map(cell, row)) + "</table:table-row>" for row in rows) + "</table:table>"
        for name, rows in book
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), mime)  # first and not compressed
        z.writestr("META-INF/manifest.xml", f'<?xml version="1.0"?><manifest:manifest xmlns:manifest="{doc}:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/>'
                   '<manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
        z.writestr("content.xml", f'<?xml version="1.0"?><office:document-content xmlns:office="{doc}:office:1.0" xmlns:table="{doc}:table:1.0" xmlns:text="{doc}:text:1.0" office:version="1.2">'
                   f"<office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>")
    return out.getvalue()
