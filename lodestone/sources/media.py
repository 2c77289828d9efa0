"""Images and PDFs as parts that an embedder takes, one row a chunk.

What needs no library is done here: formats by their first bytes, sizes, whether a GIF or WebP moves, a GIF's first frame,
PNG both ways, scaling, page counts and page subsets of PDFs.  The rest (WebP and large JPEG, raster pages) comes from
`Decoders` that the caller gives; without one, such a file is an error of its own.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import MediaOptions
from ..errors import MediaError
from . import policy
from .embed import Model

#: Pixels that an image may have, and pages of a PDF to a chunk, at most.
MOST_PIXELS, MOST_PAGES = 16_000_000, 6
PARTS = "array<struct<mime: string, data: binary>>"
PREPARED = f"path string, mtime_ns long, media_type string, chunk_idx long, content string, content_hash string, tokens long, mime_type string, media_start long, media_end long, media_unit string, truncated boolean, parts {PARTS}, error string"


@dataclass(frozen=True)
class Decoders:
    """image: bytes to height x width x 4 signs; page: PDF bytes, page and dpi to PNG bytes."""

    image: Callable[[bytes], np.ndarray] | None = None
    page: Callable[[bytes, int, int], bytes] | None = None


def kind_of(data: bytes) -> str | None:
    if data[:5] == b"%PDF-":
        return "application/pdf"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png"
    if data[:3] == b"\xff\xd8\xff":
        return "image/jpeg"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "image/gif"
    return "image/webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            break
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1:
            at += 1 if mark == 0xFF else 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise MediaError("a JPEG without a frame")


def _lzw(data: bytes, least: int) -> bytes:
    """The signs of a GIF image's compressed data."""
    clear, table, out = 1 << least, [], bytearray()
    width, bits, held, before = least + 1, 0, 0, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == clear + 1:
                return bytes(out)
            if not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                raise MediaError("a GIF with broken data")
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
    return bytes(out)


def gif(data: bytes) -> tuple[np.ndarray, bool]:
    """The first frame on its canvas, and whether there are more."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, palette = 13, np.zeros((256, 3), dtype=np.uint8)

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), dtype=np.uint8)
        table[:n] = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(n, 3)
        return table, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        out = bytearray()
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return bytes(out), at + 1

    if flags & 0x80:
        palette, at = colours(at, flags)
    clear, first = None, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9 and first is None:
                clear = data[at + 6] if data[at + 3] & 1 else None
            _, at = blocks(at + 2)
        elif data[at] == 0x2C:
            if first is not None:
                return first, True
            left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            table = palette
            if own & 0x80:
                table, at = colours(at, own)
            least = data[at]
            packed, at = blocks(at + 1)
            signs = np.frombuffer(_lzw(packed, least)[: w * h].ljust(w * h, b"\0"), dtype=np.uint8).reshape(h, w)
            if own & 0x40:  # interlaced: four passes
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                signs = signs[np.argsort(order)]
            first = np.zeros((height, width, 4), dtype=np.uint8)
            shown = first[top : top + h, left : left + w]
            signs = signs[: shown.shape[0], : shown.shape[1]]
            shown[..., :3] = table[signs]
            shown[..., 3] = 255 if clear is None else np.where(signs == clear, 0, 255)
        else:
            raise MediaError("a GIF with broken blocks")
    if first is None:
        raise MediaError("a GIF without a frame")
    return first, False


def png(image: np.ndarray) -> bytes:
    """An image of height x width x 4 signs as PNG."""
    height, width, _ = image.shape
    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), image.reshape(height, width * 4)], axis=1)

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """The signs of a PNG of 8 bits a channel without interlacing."""
    width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or laced or channels is None:
        raise MediaError("a PNG of a kind that needs a decoder")
    at, packed, palette, clear = 8, b"", None, b""
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        packed += body if name == b"IDAT" else b""
        palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3) if name == b"PLTE" else palette
        clear = body if name == b"tRNS" and kind == 3 else clear
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), dtype=np.uint8)  # with an empty row above and column before
    for y in range(height):
        row, how = rows[y, 1:].reshape(width, channels), rows[y, 0]
        above = out[y]
        if how == 0:
            out[y + 1, 1:] = row
        elif how == 1:
            out[y + 1, 1:] = np.cumsum(row, axis=0, dtype=np.uint8)
        elif how == 2:
            out[y + 1, 1:] = row + above[1:]
        else:
            line, up = [[0] * channels], above.astype(int).tolist()
            for x, signs in enumerate(row.tolist(), 1):
                now = []
                for c, s in enumerate(signs):
                    a, b, d = line[x - 1][c], up[x][c], up[x - 1][c]
                    if how == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - d
                        guess = min((a, b, d), key=lambda v: abs(p - v))  # noqa: B023  of equals, the first
                    now.append((s + guess) & 255)
                line.append(now)
            out[y + 1] = np.array(line, dtype=np.uint8)
    signs = out[1:, 1:]
    full = np.full((height, width, 4), 255, dtype=np.uint8)
    if kind == 3:
        if palette is None:
            raise MediaError("a PNG without its palette")
        full[..., :3] = palette[signs[..., 0]]
        alpha = np.frombuffer(clear.ljust(256, b"\xff"), dtype=np.uint8)
        full[..., 3] = alpha[signs[..., 0]]
    else:
        full[..., :3] = signs[..., :3] if channels > 2 else signs[..., :1]
        if channels in (2, 4):
            full[..., 3] = signs[..., -1]
    return full


def scaled(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Windowed-sinc scaling of three lobes, one axis after the other."""

    def weights(n: int, m: int) -> np.ndarray:
        step = n / m
        reach = 3 * max(1.0, step)
        centre = (np.arange(m) + 0.5) * step - 0.5
        at = np.arange(n)[None, :] - centre[:, None]
        x = at / max(1.0, step)
        w = np.where(np.abs(at) < reach, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    rows = np.einsum("hm,mwc->hwc", weights(image.shape[0], height), image.astype(np.float64))
    both = np.einsum("wn,hnc->hwc", weights(image.shape[1], width), rows)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def prepared_image(data: bytes, decoders: Decoders, most: int = MOST_PIXELS) -> tuple[str, bytes, bool]:
    """MIME type and bytes to embed, and whether frames were left out.  PNG and JPEG within the bound stay as they are."""
    mime = kind_of(data)
    if mime is None or mime == "application/pdf":
        raise MediaError("not an image of a known format")
    moves, image = False, None
    if mime == "image/png":
        width, height = struct.unpack(">II", data[16:24])
    elif mime == "image/jpeg":
        width, height = jpeg_size(data)
    elif mime == "image/gif":
        image, moves = gif(data)
        height, width = image.shape[:2]
    else:
        moves = data[12:16] == b"VP8X" and bool(data[20] & 2)
        if decoders.image is None:
            raise MediaError("WebP needs a decoder")
        image = decoders.image(data)
        height, width = image.shape[:2]
    size = policy.scaled_size(width, height, most)
    if image is None and size == (width, height):
        return mime, data, moves
    if image is None:
        if mime == "image/png":
            image = unpng(data)
        elif decoders.image is None:
            raise MediaError("a JPEG beyond the bound needs a decoder")
        else:
            image = decoders.image(data)
    return "image/png", png(image if size == (width, height) else scaled(image, *size)), moves


_PAGE, _TREE = re.compile(rb"/Type\s*/Page(?![A-Za-z])"), re.compile(rb"/Type\s*/Pages(?![A-Za-z])")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)


def _objects(data: bytes) -> dict[int, bytes]:
    """Bodies of the plain objects of a PDF, the last of each number."""
    return {int(m[1]): m[3] for m in _OBJECT.finditer(data)}


def _leaves(objects: dict[int, bytes], number: int, seen: set[int]) -> list[int]:
    body = objects.get(number, b"")
    if number in seen:
        return []
    seen.add(number)
    if _TREE.search(body):
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        return [x for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1] if kids else b"") for x in _leaves(objects, int(k), seen)]
    return [number] if _PAGE.search(body) else []


def pdf_pages(data: bytes) -> tuple[dict[int, bytes], int, list[int]]:
    """Objects, the number of the page tree's root, and those of the pages in order."""
    objects = _objects(data)
    catalog = [b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)]
    root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", catalog[-1]) if catalog else None
    if root is None:
        raise MediaError("a PDF without a readable page tree")
    return objects, int(root[1]), _leaves(objects, int(root[1]), set())


def pdf_subset(data: bytes, start: int, end: int) -> bytes:
    """The PDF with pages start to before end only, as an update behind the old content: a new root of the page tree, and
    the pages, with what they inherit, below it."""
    objects, root, pages = pdf_pages(data)
    catalog = next(n for n, b in reversed(objects.items()) if re.search(rb"/Type\s*/Catalog", b))
    out, places = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}

    def parent_of(body: bytes) -> bytes:
        p = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)
        return objects.get(int(p[1]), b"") if p else b""

    def inherited(body: bytes, name: bytes) -> bytes:
        value = re.compile(rb"/" + name + rb"\s*(\d+\s+\d+\s+R|\[.*?\]|<<.*?>>(?=\s*(?:/|>>))|\d+)", re.S)
        own, above, depth = value.search(body), parent_of(body), 0
        while own is None and above and depth < 50:
            found = value.search(above)
            if found:
                return b" /" + name + b" " + found[1]
            above, depth = parent_of(above), depth + 1
        return b""

    def put(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    for n in pages[start:end]:
        extra = b"".join(inherited(objects[n], x) for x in (b"Resources", b"MediaBox", b"CropBox", b"Rotate"))
        body = re.sub(rb"/Parent\s+\d+\s+\d+\s+R", b"/Parent %d 0 R" % root, objects[n].strip())
        put(n, body[: body.rindex(b">>")] + extra + b" >>")
    put(root, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (end - start, b" ".join(b"%d 0 R" % n for n in pages[start:end])))
    table = len(out)
    before = re.findall(rb"startxref\s+(\d+)", data)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in sorted(places.items()))
    prev = b" /Prev %s" % before[-1] if before else b""
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (max(objects) + 1, catalog, prev, table))


def prepared_pdf(data: bytes, mode: str, options: MediaOptions, decoders: Decoders) -> list[tuple[int, int, list[tuple[str, bytes]]]]:
    """First page, past the last, and parts of each chunk."""
    if mode == "none":
        raise MediaError("the model takes no PDF")
    n = len(pdf_pages(data)[2])
    if not n:
        raise MediaError("a PDF without pages")
    size = options.pdf_pages_per_chunk
    if size > MOST_PAGES:
        raise MediaError(f"more than {MOST_PAGES} pages to a chunk")
    ranges = [(s, min(s + size, n)) for s in range(0, n, size)]
    if mode == "native":
        return [(s, e, [("application/pdf", data if len(ranges) == 1 else pdf_subset(data, s, e))]) for s, e in ranges]
    if decoders.page is None:
        raise MediaError("raster pages need a decoder")
    return [(s, e, [("image/png", decoders.page(data, p, options.pdf_dpi)) for p in range(s, e)]) for s, e in ranges]


def prepare(data: bytes, model: Model, options: MediaOptions, decoders: Decoders) -> list[dict]:
    """Chunks of one file, by what its bytes are."""
    if not model.media:
        raise MediaError(f"{model.name} takes no media")
    if kind_of(data) == "application/pdf":
        kind, found = "pdf", [(s, e, parts, False) for s, e, parts in prepared_pdf(data, model.pdf, options, decoders)]
    else:
        mime, body, moves = prepared_image(data, decoders)
        kind, found = "image", [(None, None, [(mime, body)], moves)]
    out = []
    for i, (s, e, parts, moves) in enumerate(found):
        out.append({"media_type": kind, "chunk_idx": i, "content": "", "content_hash": policy.cache_key(kind, parts), "tokens": 0, "mime_type": parts[0][0] if len(parts) == 1 else "multipart", "media_start": s, "media_end": e, "media_unit": None if s is None else "page", "truncated": moves, "parts": [{"mime": m, "data": d} for m, d in parts], "error": None})
    return out


def prepared(files: DataFrame, model: Model, options: MediaOptions, decoders: Decoders) -> DataFrame:
    """Chunk rows of media files (path, media_type, mtime_ns, data); a file that fails is one row with its error."""
    names = [c.split()[0] for c in PREPARED.replace(PARTS, "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, kind, mtime, data in zip(f["path"], f["media_type"], f["mtime_ns"], f["data"], strict=True):
                try:
                    made = prepare(bytes(data), model, options, decoders)
                except (MediaError, struct.error, IndexError, ValueError, zlib.error) as e:
                    made = [{"media_type": kind, "error": f"{type(e).__name__}: {e}"[:200]}]
                rows += [{"path": path, "mtime_ns": mtime} | m for m in made]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return files.select("path", "media_type", "mtime_ns", "data").mapInPandas(run, PREPARED)
