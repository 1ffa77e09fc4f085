"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every known magic string in one pass over the bytes; a validator for each format then
confirms the structure and gives the length, so that a declared type can be corrected and media embedded in other
bytes can be carved. `store_as_wave` keeps any bytes losslessly as 8-bit samples in such a container.

Validators walk a medium's own lengths and checksums, so a finding ends where the medium does: a FLAC stream ends with
the frame that completes the samples it declares, a PDF with the last `startxref` that points into it, before the next
PDF header, an Ogg stream with the last page of all its streams. A ZIP archive is told by its end record: that says where
the archive begins, and only if its directory and all members lie as it says, from there on, is it one. Magic bytes that
are an archive's or a stream's own, of members and pages, begin nothing; what members hold is searched. Compressed
members are unpacked in pieces of fixed size, whatever they hold.

Defined results: null bytes count as empty, which no format matches; a match whose structure is not whole, or an image
without an image in it, is no finding; media of one beginning are listed by format; repeated rows are treated each on its
own; very long contents are walked whole, in one row's memory; extra columns are kept (`sniff_media`; of the names
sniffed_type and embedded, the new ones) or ignored (`media_features`); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import wave
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import bounded, map_texts

RATE, BLOCK = 8000, 64
FOUND = "array<struct<type:string,start:bigint,end:bigint,sha256:string>>"
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, " + f"embedded {FOUND}"

# Magic bytes of public formats and where they stand in a file.
MAGIC: dict[bytes, tuple[str, int]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"RIFF": ("riff", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("audio/ogg", 0),
}


def _png(b: bytes, at: int) -> int:
    i, image = at + 8, False
    while i + 12 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, i), b[i + 4 : i + 8]
        end = i + 12 + n
        if end > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0] or i == at + 8 and kind != b"IHDR":
            return 0
        if kind == b"IEND":
            return end if image else 0
        image |= kind == b"IDAT"
        i = end
    return 0


#: Markers of frames, without tables that share their range.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _jpeg(b: bytes, at: int) -> int:
    i, frame, scan = at + 2, False, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xD9:
            break
        frame |= kind in FRAMES
        scan |= frame and kind == 0xDA
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
        if kind == 0xDA:  # entropy-coded data: FF is followed by 00 or a restart mark until the next segment
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return 0
    return i + 2 if scan and b[i : i + 2] == b"\xff\xd9" else 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags, i = b[at + 10], at + 13
    i += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    image = False
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 if image else 0
        image |= b[i] == 0x2C
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            packed = b[i + 9]
            i = blocks(i + 11 + (3 << (packed & 7) + 1 if packed & 0x80 else 0))
        else:
            return 0
    return 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i, kinds = at + 12, []
    while i + 8 <= min(end, len(b)):
        kinds.append(b[i : i + 4])
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + (n & 1)
    need = {b"WAVE": (b"fmt ",), b"AVI ": (b"LIST",), b"WEBP": (b"VP8 ", b"VP8L", b"VP8X")}.get(b[at + 8 : at + 12], ())
    return end if end <= len(b) and i in (end, end + 1) and any(k in kinds for k in need) else 0


PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
PDF_TABLE = re.compile(rb"xref|\d+\s+\d+\s+obj")


def _pdf(b: bytes, at: int) -> int:
    """The last end, before another header, whose table stands where it is said to."""
    following = b.find(b"%PDF-", at + 5)
    end = 0
    for m in PDF_END.finditer(b, at, following if following > 0 else len(b)):
        table = at + int(m[1][:12])
        if at < table < m.start() and PDF_TABLE.match(b, table):
            end = m.end()
    return end


def _zip_at(b: bytes, end: int) -> tuple[int, list[int]] | None:
    """Where the archive of an end record begins, and the places of its members, which follow one another up to the directory."""
    _, _, here, entries, size, offset, _ = struct.unpack_from("<HHHHIIH", b, end + 4)
    directory, begin = end - size, end - size - offset
    if begin < 0 or here != entries or not entries:
        return None
    i, members = directory, []
    for _ in range(entries):
        if b[i : i + 4] != b"PK\x01\x02" or i + 46 > end:
            return None
        flags, packed, name, extra, note, place = (struct.unpack_from(f, b, i + at)[0] for f, at in (("<H", 8), ("<I", 20), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        members.append((begin + place, flags, packed, b[i + 46 : i + 46 + name]))
        i += 46 + name + extra + note
    members.sort()
    if i != end or members[0][0] != begin:
        return None
    for (at, flags, packed, name), following in zip(members, [*(m[0] for m in members[1:]), directory], strict=True):
        if b[at : at + 4] != b"PK\x03\x04" or at + 30 > directory:
            return None
        named, extra = struct.unpack_from("<HH", b, at + 26)
        over = following - (at + 30 + named + extra + packed)
        # sizes that were not known at first stand behind the member, in 12 or 16 bytes
        if b[at + 30 : at + 30 + named] != name or over not in ((12, 16) if flags & 8 else (0,)):
            return None
    return begin, [m[0] for m in members]


def _zips(b: bytes) -> dict[int, tuple[int, list[int]]]:
    """End and members of each whole archive, by its beginning."""
    out = {}
    end = b.find(b"PK\x05\x06")
    while 0 <= end and end + 22 <= len(b):
        note = struct.unpack_from("<H", b, end + 20)[0]
        if end + 22 + note <= len(b) and (found := _zip_at(b, end)):
            out.setdefault(found[0], (end + 22 + note, found[1]))
        end = b.find(b"PK\x05\x06", end + 4)
    return out


PIECE = 1 << 16


def _gzip(b: bytes, at: int) -> int:
    """Unpacked piece by piece; what comes out is dropped, its checksum and length are compared by the library."""
    z, i = zlib.decompressobj(31), at
    try:
        while not z.eof:
            left = z.unconsumed_tail
            if not left:
                if i >= len(b):
                    return 0
                left, i = b[i : i + PIECE], i + PIECE
            z.decompress(left, PIECE)
    except zlib.error:
        return 0
    return min(i, len(b)) - len(z.unused_data)


def _crc_table(poly: int, bits: int) -> list[int]:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for i in range(256):
        c = i << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Samples a frame by the four bits of its header that tell; 6 and 7 stand for one or two bytes that follow.
FLAC_BLOCKS = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}


def _flac_frame(b: bytes, at: int) -> tuple[int, int]:
    """(bytes of the header, samples of the frame) at a place, or zeros."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return 0, 0
    block, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = b[at + 4]
    number = 1 if lead < 0x80 else next((n for n in range(2, 8) if lead >> 7 - n == (1 << n + 1) - 2), 0)
    size = 4 + number + {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not number or rate == 15 or at + size >= len(b):
        return 0, 0
    crc = 0
    for x in b[at : at + size]:
        crc = CRC8[crc ^ x]
    more = b[at + 4 + number : at + 4 + number + 2]
    samples = FLAC_BLOCKS.get(block) or {6: more[0] + 1, 7: int.from_bytes(more, "big") + 1}.get(block, 0)
    return (size + 1, samples) if crc == b[at + size] else (0, 0)


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks by their lengths, then frames: each runs to where its checksum holds and another frame or the end of
    the declared samples follows."""
    if at + 42 > len(b) or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    declared = int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
    i, last = at + 4, False
    while not last:
        if i + 4 > len(b):
            return 0
        last, i = bool(b[i] & 0x80), i + 4 + int.from_bytes(b[i + 1 : i + 4], "big")
    held = 0
    while held < declared or not declared:
        header, samples = _flac_frame(b, i)
        if not header:
            break
        crc, end = 0, 0
        for j in range(i, len(b)):
            crc = (crc << 8 ^ CRC16[crc >> 8 ^ b[j]]) & 0xFFFF
            # over a frame and its own checksum, the sum is zero
            if not crc and j > i + header + 1 and (_flac_frame(b, j + 1)[0] or held + samples >= declared):
                end = j + 1
                break
        if not end:
            return 0
        held, i = held + samples, end
    return i if held and held >= declared else 0


#: Each byte with its bits in reverse.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_sum(page: bytes) -> int:
    """The checksum of a page: the common one's polynomial from the other end, from zero, so bits go in and out reversed."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> tuple[int, list[int]]:
    """End and pages of streams that begin at a place: the first page begins one, each page's checksum holds, those of a stream
    are numbered on, and it ends when all that began have ended."""
    i, pages, opened, ended = at, [], {}, set()
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and i + 27 + b[i + 26] <= len(b):
        flags = b[i + 5]
        serial, number, crc = struct.unpack_from("<III", b, i + 14)
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if b[i + 4] or end > len(b) or _ogg_sum(b[i : i + 22] + b"\0\0\0\0" + b[i + 26 : end]) != crc:
            break
        if bool(flags & 2) == (serial in opened) or serial in ended or number != opened.get(serial, number - 1) + 1:
            break
        opened[serial] = number
        pages.append(i)
        if flags & 4:
            ended.add(serial)
        i = end
        if len(ended) == len(opened):
            return i, pages
    return 0, []


VALIDATE = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "riff": _riff, "application/pdf": _pdf, "application/gzip": _gzip, "audio/flac": _flac}
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in MAGIC:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of every whole medium in data, outermost and nested ones alike, by start."""
    out = []
    places = sorted((last + 1 - len(magic) - MAGIC[magic][1], MAGIC[magic][0]) for last, magic in _automaton().iter(data.decode("latin-1")))
    archives = _zips(data) if any(kind == "application/zip" for _, kind in places) else {}
    own: set[int] = set()  # places of pages of a stream that was found
    for at, kind in places:
        end = 0
        try:
            if kind == "application/zip":
                end = archives.get(at, (0,))[0]
            elif kind == "audio/ogg":
                end, pages = (0, []) if at in own else _ogg(data, at)
                own.update(pages)
            elif at >= 0:
                end = VALIDATE[kind](data, at)
        except (struct.error, IndexError):
            end = 0
        if end:
            out.append((RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind, at, end))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def corrected(data: bytes, declared: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type that the bytes prove (else the declared one), and the media embedded within."""
    found = sniff(data)
    whole = next((x for x in found if x[1] == 0), None)
    return (whole[0] if whole else declared), [x for x in found if x is not whole]


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """df with sniffed_type and embedded (type, start, end, sha256 of the carved bytes). Narrow: no shuffle."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    df = df.drop(*({"sniffed_type", "embedded"} - {content, declared}))
    schema = StructType(df.schema.fields + StructType.fromDDL(f"sniffed_type string, embedded {FOUND}").fields)
    arrow = to_arrow_schema(schema)

    def run(rows):
        for batch in rows:
            kinds, parts = [], []
            named = batch.column(declared).to_pylist() if declared else [None] * batch.num_rows
            for data, kind in zip(batch.column(content).to_pylist(), named, strict=True):
                kind, inner = corrected(bytes(data or b""), kind)
                kinds.append(kind)
                parts.append([{"type": k, "start": s, "end": e, "sha256": hashlib.sha256(data[s:e]).hexdigest()} for k, s, e in inner])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(parts, arrow.field("embedded").type)], schema=arrow)

    return bounded(df).mapInArrow(run, schema)


def carve(data: bytes) -> list[bytes]:
    """The bytes of every whole medium within data."""
    return [data[s:e] for _, s, e in sniff(data)]


def store_as_wave(payload: bytes) -> bytes:
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return held.getvalue()


def samples(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def media_features(docs: DataFrame) -> DataFrame:
    """Each text of docs(doc_id, text) stored as a sound, sniffed, read back and described. Narrow: no shuffle."""

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        stored = store_as_wave(raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0"))
        kind, inner = corrected(stored, "application/octet-stream")
        back = samples(stored)
        values = np.frombuffer(back, np.uint8)
        edges = int(np.count_nonzero((values[1:] >= 128) != (values[:-1] >= 128)))
        feature = f"{kind};frames={len(back)};embedded={len(inner)};sum={int(values.sum(dtype=np.int64))};peak={int(values.max())};crossings={edges}"
        carved = [{"type": k, "start": s, "end": e, "sha256": hashlib.sha256(stored[s:e]).hexdigest()} for k, s, e in inner]
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, carved

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "embedded")

    def fn(piece):
        got = [one(t) for t in piece["text"]]
        return {"doc_id": piece["doc_id"]} | {name: [g[i] for g in got] for i, name in enumerate(names)}

    return map_texts(docs, fn, SCHEMA)
