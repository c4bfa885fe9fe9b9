"""Path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp")
#: Media types by file type, and of images by extension (others are JPEG).
MIME = {"md": "text/markdown", "pdf": "application/pdf"}
IMAGE_MIME = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def extension(path: Column) -> Column:
    """Lower-case extension; null without one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1)), F.lit(""))


def file_type(path: Column) -> Column:
    """Type by extension; null without one."""
    e = extension(path)
    return F.when(e.isin(*IMAGES), "image").when(e == "htm", "html").otherwise(e)


def relative(path: Column, root: str) -> Column:
    """Path below the root with forward slashes."""
    own = root.rstrip("/\\").replace("\\", "/") + "/"
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(own), F.substring(slashed, len(own) + 1, 2**31 - 1)).otherwise(slashed)


def is_safe(path: Column) -> Column:
    """Whether no part of the path leads upward."""
    return ~F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")


def is_hidden(path: Column) -> Column:
    """Whether a part of the path starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def folders(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def mime(path: Column) -> Column:
    """Media type by file type; what a viewer does not show as such is a stream of octets."""
    out, own = F, file_type(path)
    for e, m in IMAGE_MIME.items():
        out = out.when(extension(path) == e, m)
    out = out.when(own == "image", "image/jpeg")
    for e, m in MIME.items():
        out = out.when(own == e, m)
    return out.otherwise("application/octet-stream")
