"""Headers of images and audio files: sizes, rates, durations, tags. Nothing is decoded."""

from __future__ import annotations

import struct

from quillmill.sources.parsers.texts import Page

# Bit rates (kbit/s) of MPEG-1 and MPEG-2 Layer III by index, and sampling rates.
LAYER3 = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
ID3_NAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TYER": "year", "TDRC": "year", "TCON": "genre", "TRCK": "track"}


def image_size(d: bytes) -> tuple[str, int, int, dict]:
    if d.startswith(b"\x89PNG"):
        w, h, depth, kind = struct.unpack(">IIBB", d[16:26])
        return "PNG", w, h, {"bit_depth": depth, "mode": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "?")}
    if d.startswith((b"GIF87a", b"GIF89a")):
        return "GIF", *struct.unpack("<HH", d[6:10]), {"mode": "P"}
    if d.startswith(b"BM"):
        w, h = struct.unpack("<ii", d[18:26])
        return "BMP", w, abs(h), {"bit_depth": struct.unpack("<H", d[28:30])[0]}
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        if d[12:16] == b"VP8X":
            return "WEBP", int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1, {}
        if d[12:16] == b"VP8L":
            n = int.from_bytes(d[21:25], "little")
            return "WEBP", (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1, {"lossless": True}
        w, h = struct.unpack("<HH", d[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF, {}
    if d[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(d):
            if d[at] != 0xFF:
                at += 1
                continue
            mark, n = d[at + 1], struct.unpack(">H", d[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", d[at + 5 : at + 9])
                return "JPEG", w, h, {"mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(d[at + 9], "?")}
            at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9 else 2 + n
        raise ValueError("no frame header")
    if d[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if d[:2] == b"II" else ">"
        at = struct.unpack(f"{order}I", d[4:8])[0]
        found = {}
        for i in range(struct.unpack(f"{order}H", d[at : at + 2])[0]):
            tag, kind, _ = struct.unpack(f"{order}HHI", d[at + 2 + 12 * i : at + 10 + 12 * i])
            if tag in (256, 257):
                found[tag] = struct.unpack(f"{order}H" if kind == 3 else f"{order}I", d[at + 10 + 12 * i : at + (12 if kind == 3 else 14) + 12 * i])[0]
        return "TIFF", found[256], found[257], {}
    raise ValueError("not a known image")


def image(data: bytes, options: dict) -> list[dict]:
    kind, w, h, more = image_size(data)
    page = Page()
    page.add("image", f"[图片] {kind} {w}x{h}", {"format": kind, "width": w, "height": h, **more})
    return [page.done(raw="", has_image=True, meta={"width": w, "height": h, "format": kind, **more})]


def wav(d: bytes) -> dict:
    out, at = {"container": "WAV"}, 12
    while at + 8 <= len(d):
        name, n = d[at : at + 4], struct.unpack("<I", d[at + 4 : at + 8])[0]
        if name == b"fmt ":
            _, out["channels"], out["sample_rate"], out["byte_rate"], _, out["bits"] = struct.unpack("<HHIIHH", d[at + 8 : at + 24])
        elif name == b"data" and out.get("byte_rate"):
            out["duration"] = n / out["byte_rate"]
        at += 8 + n + n % 2
    return out


def id3(d: bytes) -> tuple[dict, int]:
    """Tags at the start, and their length."""
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    total, version, tags, at = size(d[6:10]) + 10, d[3], {}, 10
    while at + 10 < min(total, len(d)) and d[at : at + 4].strip(b"\0"):
        n = size(d[at + 4 : at + 8]) if version == 4 else struct.unpack(">I", d[at + 4 : at + 8])[0]
        name, body = d[at : at + 4].decode("latin-1"), d[at + 10 : at + 10 + n]
        if name in ID3_NAMES and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[ID3_NAMES[name]] = body[1:].decode(code, "replace").strip("\0 ")
        at += 10 + n
    return tags, total


def mp3(d: bytes) -> dict:
    out, at = {"container": "MP3"}, 0
    if d.startswith(b"ID3"):
        tags, at = id3(d)
        out |= tags
    if d[-128:-125] == b"TAG":
        text = lambda a, b: d[-128:][a:b].decode("latin-1").strip("\0 ")
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text(a, b):
                out.setdefault(key, text(a, b))
    while at + 4 < len(d):
        if d[at] == 0xFF and d[at + 1] & 0xE0 == 0xE0 and d[at + 1] >> 1 & 3 == 1:
            version, rate, index = d[at + 1] >> 3 & 3, d[at + 2] >> 2 & 3, d[at + 2] >> 4
            if version != 1 and rate < 3 and 0 < index < 15:
                out["bitrate"] = LAYER3[version != 3][index] * 1000
                out["sample_rate"] = RATES[version][rate]
                out["channels"] = 1 if d[at + 3] >> 6 == 3 else 2
                out["duration"] = (len(d) - at) * 8 / out["bitrate"]
                break
        at += 1
    return out


def vorbis(d: bytes) -> dict:
    n = struct.unpack("<I", d[:4])[0]
    count, at, out = struct.unpack("<I", d[4 + n : 8 + n])[0], 8 + n, {}
    for _ in range(min(count, 200)):
        n = struct.unpack("<I", d[at : at + 4])[0]
        key, _, value = d[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if key.lower() in ("title", "artist", "album", "date", "genre", "tracknumber"):
            out[key.lower()] = value
        at += 4 + n
    return out


def flac(d: bytes) -> dict:
    out, at, last = {"container": "FLAC"}, 4, False
    while not last and at + 4 <= len(d):
        last, kind, n = bool(d[at] & 0x80), d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        body = d[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"sample_rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1}
            if out["sample_rate"]:
                out["duration"] = (packed & (1 << 36) - 1) / out["sample_rate"]
        elif kind == 4:
            out |= vorbis(body)
        at += 4 + n
    return out


def ogg(d: bytes) -> dict:
    out = {"container": "OGG"}
    body = d[27 + d[26] :]
    if body[1:7] == b"vorbis":
        out["channels"], out["sample_rate"] = struct.unpack("<BI", body[11:16])
    elif body.startswith(b"OpusHead"):
        out |= {"channels": body[9], "sample_rate": 48_000}
    at = d.rfind(b"OggS")
    if at >= 0 and out.get("sample_rate"):
        out["duration"] = struct.unpack("<q", d[at + 6 : at + 14])[0] / out["sample_rate"]
    mark = d.find(b"\x03vorbis")
    return out | (vorbis(d[mark + 7 :]) if mark > 0 else {})


def aiff(d: bytes) -> dict:
    out, at = {"container": "AIFF"}, 12
    while at + 8 <= len(d):
        n = struct.unpack(">I", d[at + 4 : at + 8])[0]
        if d[at : at + 4] == b"COMM":
            out["channels"], frames, out["bits"] = struct.unpack(">hIh", d[at + 8 : at + 16])
            exponent, mantissa = struct.unpack(">HQ", d[at + 16 : at + 26])
            out["sample_rate"] = int(mantissa * 2.0 ** (exponent - 16_446))
            out["duration"] = frames / out["sample_rate"] if out["sample_rate"] else None
        at += 8 + n + n % 2
    return out


def m4a(d: bytes) -> dict:
    """Boxes are followed down to the movie header, which has the time scale and the duration."""
    out, todo = {"container": "M4A"}, [(0, len(d))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            n, name = struct.unpack(">I4s", d[at : at + 8])
            n = end - at if n == 0 else struct.unpack(">Q", d[at + 8 : at + 16])[0] if n == 1 and at + 16 <= end else n
            if n < 8:
                break
            if name in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                todo.append((at + 8, min(at + n, end)))
            elif name == b"mvhd":
                scale, length = struct.unpack(">II", d[at + 20 : at + 28]) if d[at + 8] == 0 else struct.unpack(">IQ", d[at + 28 : at + 40])
                out["duration"] = length / scale if scale else None
            elif name == b"stsd" and at + 50 <= end:
                out["channels"], out["bits"] = struct.unpack(">HH", d[at + 40 : at + 44])
                out["sample_rate"] = struct.unpack(">I", d[at + 48 : at + 52])[0] >> 16
            at += n
    return out


def audio(data: bytes, options: dict) -> list[dict]:
    d = data
    if d[:4] == b"RIFF":
        meta = wav(d)
    elif d[:4] == b"fLaC":
        meta = flac(d)
    elif d[:4] == b"OggS":
        meta = ogg(d)
    elif d[:4] == b"FORM":
        meta = aiff(d)
    elif d[4:8] == b"ftyp":
        meta = m4a(d)
    else:
        meta = mp3(d)
    page = Page()
    page.add("text", "\n".join(f"{k}: {v}" for k, v in meta.items()), meta)
    return [page.done(has_image=False, has_table=False, meta=meta)]
