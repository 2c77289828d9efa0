"""Which files belong to the corpus, as predicates on relative paths, and what identifies their content."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MEDIA_PROTOCOL, MediaOptions

#: File extensions by media type, and folders that are never entered.
EXTENSIONS = {"text": ("md", "txt"), "image": ("png", "jpg", "jpeg", "webp", "gif"), "pdf": ("pdf",)}
SKIPPED = (".git", ".obsidian", "node_modules")
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "pdf": "application/pdf"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))


def media_type_of(path: Column) -> Column:
    """text, image or pdf by extension; null for others."""
    out = None
    for kind, names in EXTENSIONS.items():
        hit = extension(path).isin(*names)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def is_safe(path: Column) -> Column:
    """Relative, not empty, and no part is hidden, skipped or leads up.  A lone "." stands for the folder itself."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p != ".") & (F.startswith(p, F.lit(".")) | p.isin(*SKIPPED)))
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~bad


def glob_pattern(glob: str, key: str = "glob") -> str:
    """A glob as a regular expression; `*` also crosses "/", `{a,b}` and `[...]` as usual."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            i += len(re.match(r"\*+", glob[i:])[0]) - 1
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"{key} {glob!r}: invalid glob: unclosed character class")
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"{key} {glob!r}: invalid glob: unclosed alternate group")
    return f"(?s)\\A{out}\\z"


def _matches(path: Column, globs: Sequence[str], key: str) -> Column:
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for g in globs:
        out = out | slashes.rlike(glob_pattern(g, key))
    return out


def classified(path: Column, o: MediaOptions) -> Column:
    """The media type of a path that the policy allows; null for others.  An exclusion wins over an inclusion."""
    kind = media_type_of(path)
    allowed = F.lit(o.enabled) & ~kind.isin(*(o.exclude_types or ("",)))
    if o.include:
        allowed = allowed & _matches(path, o.include, "include")
    if o.exclude:
        allowed = allowed & ~_matches(path, o.exclude, "exclude")
    return F.when(is_safe(path) & ((kind == "text") | allowed), kind)


def allowed_size(kind: Column, size: Column, o: MediaOptions) -> Column:
    return (kind == "text") | (size <= o.max_file_mb * 1024 * 1024)


def profile(o: MediaOptions) -> str:
    return "|".join([MEDIA_PROTOCOL, f"max_file_mb={o.max_file_mb}", f"pdf_pages_per_chunk={o.pdf_pages_per_chunk}", f"pdf_dpi={o.pdf_dpi}"])


def effective_hash(content: Column, kind: Column, o: MediaOptions) -> Column:
    """SHA-256 of the bytes; of media, also of how they would be processed."""
    data = content.cast("binary")
    return F.when(kind == "text", F.sha2(data, 256)).otherwise(F.sha2(F.concat(data, F.unhex(F.lit("00")), F.lit(profile(o)).cast("binary")), 256))


def sniffed(content: Column) -> Column:
    """A medium's MIME type by its first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit(b"%PDF-".hex().upper())), "application/pdf").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(head, F.lit(b"GIF8".hex().upper())), "image/gif").when(F.startswith(head, F.lit(b"RIFF".hex().upper())) & F.endswith(head, F.lit(b"WEBP".hex().upper())), "image/webp")
    )


def framed(parts: Sequence[tuple[str, bytes]]) -> bytes:
    out = struct.pack("<Q", len(parts))
    for mime, data in parts:
        out += struct.pack("<Q", len(mime)) + mime.encode() + struct.pack("<Q", len(data)) + data
    return out


def cache_key(media_type: str, parts: Sequence[tuple[str, bytes]], mime: str = "multipart") -> str:
    """What a medium's embedding is cached under."""
    data = framed(parts) if mime == "multipart" else parts[0][1]
    return hashlib.sha256(b"\0".join([MEDIA_PROTOCOL.encode(), media_type.encode(), mime.encode(), data])).hexdigest()


def _le64(n: Column) -> Column:
    """A number as eight bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def cache_key_of(media_type: str, mime: str, data: Column) -> Column:
    """`cache_key` of a single part, over rows of bytes."""
    nul, text = F.unhex(F.lit("00")), lambda x: F.lit(x).cast("binary")
    head = F.concat(text(MEDIA_PROTOCOL), nul, text(media_type), nul, text("multipart"), nul)
    return F.sha2(F.concat(head, _le64(F.lit(1)), _le64(F.lit(len(mime))), text(mime), _le64(F.octet_length(data).cast("long")), data), 256)


def scaled_size(width: int, height: int, most: int) -> tuple[int, int]:
    """An image's size within a number of pixels."""
    if width * height <= most:
        return width, height
    s = (most / (width * height)) ** 0.5
    return max(1, int(width * s)), max(1, int(height * s))
