"""Images of pages: data urls, captured images, and local files."""

from __future__ import annotations

import base64
import binascii
import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import IMAGE_ID, MAX_IMAGE_BYTES
from .urls import safe_url

if TYPE_CHECKING:
    from .html import Node

#: Images of a page that become assets.
MAX_IMAGES = 20
# Fixed values.
DATA = re.compile(r"(?i)data:(image/(?:png|jpeg|webp|gif|svg\+xml));base64,([a-z0-9+/=\s]+)")
EXTENSIONS = {"image/jpeg": ".jpg", "image/svg+xml": ".svg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}
TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".avif": "image/avif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".ico": "image/vnd.microsoft.icon", ".apng": "image/apng"}


def data_image(value: str | None) -> tuple[bytes, str, str] | None:
    """(content, mime type, extension) of a base64 image data url of 1 byte to 25 MiB."""
    m = DATA.fullmatch(value or "")
    if not m:
        return None
    body = re.sub(r"\s", "", m[2]).split("=", 1)[0]
    try:
        content = base64.b64decode(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4 % 3))
    except binascii.Error:
        return None
    mime = m[1].lower()
    return (content, mime, EXTENSIONS[mime]) if 0 < len(content) <= MAX_IMAGE_BYTES else None


def image_extension(path: str, mime: str) -> str:
    """The path's own extension if it is a plain one, else that of the mime type."""
    m = re.search(r"(?<=[^/])(\.[^./]*)$", path.rsplit("/", 1)[-1])
    own = m[1].lower() if m else ""
    if re.fullmatch(r"\.[a-z0-9]{1,8}", own):
        return own
    return EXTENSIONS.get(mime) or (f".{mime[6:]}" if mime.startswith("image/") else ".img")


def marker_id(value: str | None, fallback: int) -> str:
    return value if value and re.fullmatch(IMAGE_ID, value) else f"image-{fallback:03d}"


def asset(image_id: str, mime: str, extension: str, alt: str | None, source: str | None, path: str | None, content: bytes | None) -> dict:
    return {"id": image_id, "mime": mime, "filename": image_id + extension, "alt": alt or None, "source_url": source, "path": path, "content": content}


def attach_captured(elements: list[Node], captured: list[dict], base: str) -> tuple[list[dict], dict[int, str]]:
    """Assets of the first 20 captured images that can be read, and the ids of the page's elements they stand for.

    An image keeps its id if that is valid and free, else it gets the next free
    one.  It belongs to the element that holds its id, or, without one, to that
    of its place.
    """
    assets, used, known = [], set(), {}
    held = {id(n): n.attrs.get("data-image-id") for n in elements}
    for image in captured[: MAX_IMAGES]:
        found = data_image(image.get("data_url"))
        if not found:
            continue
        content, mime, extension = found
        image_id = marker_id(image.get("id"), len(assets) + 1)
        if image_id in used:
            image_id = marker_id(None, len(assets) + 1)
        while image_id in used:
            image_id = marker_id(None, int(image_id[6:]) + 1)
        used.add(image_id)
        if image.get("id"):
            node = next((n for n in elements if held[id(n)] == image["id"]), None)
        else:
            node = elements[len(assets)] if len(assets) < len(elements) else None
        if node is not None:
            known[id(node)] = held[id(node)] = image_id
        source = safe_url(image["source_url"], base) if image.get("source_url") else None
        assets.append(asset(image_id, mime, extension, image.get("alt") or image.get("label"), source, None, content))
    return assets, known


def asset_rows(bundles: DataFrame) -> DataFrame:
    """page_id, ordinal (from 0) and the fields of each asset."""
    return bundles.select("page_id", F.posexplode("assets").alias("ordinal", "a")).select("page_id", "ordinal", "a.*")


def with_files(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Asset rows with the content of ``binaryFile`` rows for those that have a path; assets whose file is missing go."""
    held = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("_path"), F.col("content").alias("_content"))
    met = assets.join(held, assets["path"] == F.col("_path"), "left")
    return met.where(F.col("path").isNull() | F.col("_content").isNotNull()).withColumn("content", F.coalesce("content", "_content")).drop("_path", "_content")
