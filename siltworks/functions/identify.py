"""Type detection: the first evidence that fits decides. Magic numbers are also offered as an expression for plain columns."""

from __future__ import annotations

import io
import json
import re
import tarfile
import zipfile
from pathlib import PurePosixPath
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY_VERSION = 1
MARKER_BYTES = 1 << 16


class Kind(NamedTuple):
    media_type: str
    group: str
    extension: str
    method: str
    container: str | None = None
    reason: str | None = None
    registry_version: int = REGISTRY_VERSION


#: (offset, bytes, media type, group, extension)
MAGIC = [
    (0, b"\x89PNG\r\n\x1a\n", "image/png", "images", ".png"),
    (0, b"\xff\xd8\xff", "image/jpeg", "images", ".jpg"),
    (0, b"GIF8", "image/gif", "images", ".gif"),
    (0, b"II*\0", "image/tiff", "images", ".tif"),
    (0, b"MM\0*", "image/tiff", "images", ".tif"),
    (0, b"ID3", "audio/mpeg", "audio", ".mp3"),
    (0, b"fLaC", "audio/flac", "audio", ".flac"),
    (0, b"SQLite format 3\0", "application/vnd.sqlite3", "data", ".sqlite"),
]
_TABLE = """images png image/png | images jpg image/jpeg | images gif image/gif | images tif image/tiff | images webp image/webp | video mp4 video/mp4 | video mov video/quicktime | video mkv video/x-matroska
| audio mp3 audio/mpeg | audio wav audio/wav | audio flac audio/flac | documents doc application/msword | documents rtf application/rtf | documents txt text/plain | spreadsheets csv text/csv | spreadsheets xls application/vnd.ms-excel
| presentations ppt application/vnd.ms-powerpoint | ebooks mobi application/x-mobipocket-ebook | fonts ttf font/ttf | fonts otf font/otf | data json application/json | data xml application/xml | data yaml application/yaml
| data sqlite application/vnd.sqlite3 | email eml message/rfc822"""
_ROWS = [x.split() for x in _TABLE.split("|")]
_ALIAS = {"jpeg": "jpg", "tiff": "tif", "yml": "yaml", "db": "sqlite"}
#: suffix -> (media type, group, canonical suffix)
EXTENSIONS = {"." + e: (m, g, "." + e) for g, e, m in _ROWS}
EXTENSIONS |= {"." + a: EXTENSIONS["." + e] for a, e in _ALIAS.items()}
TAR_ENDINGS = (".tar", ".tgz", ".tbz", ".tbz2", ".txz", ".tzst", ".tar.gz", ".tar.bz2", ".tar.xz", ".tar.zst")
#: (profile, group, test of the names); odf-like profiles are tested by their mimetype member
_NAMED = [("docx", "documents", "word/"), ("xlsx", "spreadsheets", "xl/"), ("pptx", "presentations", "ppt/")]
_TYPED = [
    ("odt", "documents", b"application/vnd.oasis.opendocument.text"),
    ("ods", "spreadsheets", b"application/vnd.oasis.opendocument.spreadsheet"),
    ("odp", "presentations", b"application/vnd.oasis.opendocument.presentation"),
    ("epub", "ebooks", b"application/epub+zip"),
]
_HELD = [("war", {"WEB-INF/web.xml"}), ("ear", {"META-INF/application.xml"}), ("jar", {"META-INF/MANIFEST.MF"}), ("apk", {"AndroidManifest.xml", "classes.dex"}), ("aab", {"BundleConfig.pb", "base/manifest/AndroidManifest.xml"})]


def package(payload: bytes) -> Kind | None:
    """The first package profile that a ZIP file fits."""
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as z:
            names = {i.filename.replace("\\", "/") for i in z.infolist()}
            label = None
            if "[Content_Types].xml" in names:
                label = next(((p, g) for p, g, lead in _NAMED if any(n.startswith(lead) for n in names)), None)
            if label is None and "mimetype" in names and z.getinfo("mimetype").file_size <= MARKER_BYTES:
                with z.open("mimetype") as f:
                    said = f.read(MARKER_BYTES).strip()
                label = next(((p, g) for p, g, mark in _TYPED if said == mark), None)
            label = label or next(((p, "packages") for p, need in _HELD if need <= names), None)
            if label is None and any(n.endswith(".dist-info/WHEEL") for n in names):
                label = ("whl", "packages")
            if label is None and any(n.endswith(".nuspec") for n in names):
                label = ("nupkg", "packages")
            if label is None and "extension.vsixmanifest" in names:
                label = ("vsix", "packages")
    except (OSError, ValueError, KeyError, RuntimeError, NotImplementedError, zipfile.BadZipFile):
        return None
    return label and Kind("application/x-" + label[0], label[1], "." + label[0], "package_profile")


def _maybe_tar(payload: bytes) -> bool:
    """False only where ``tarfile`` finds nothing in any way it tries: plain, gzip, bzip2, xz and old LZMA."""
    if payload.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ\0")):
        return True
    # old LZMA has no mark, but its dictionary's size is the sum of at most two powers of two, or all ones
    if not all(payload[1:5]) or payload[1:5] == b"\xff\xff\xff\xff":
        return True
    if len(payload) < tarfile.BLOCKSIZE:
        return False
    try:
        tarfile.TarInfo.frombuf(payload[: tarfile.BLOCKSIZE], "utf-8", "surrogateescape")
    except (tarfile.InvalidHeaderError, UnicodeError, ValueError):
        return False
    except tarfile.HeaderError:
        pass
    return True


def is_tar(payload: bytes, name: str) -> bool:
    if name.casefold().endswith(TAR_ENDINGS):
        return True
    if not _maybe_tar(payload):  # what most contents need; tarfile opens each in several ways
        return False
    try:
        return tarfile.is_tarfile(io.BytesIO(payload))
    except (OSError, EOFError, ValueError):
        return False


def pdf(payload: bytes) -> Kind:
    """A structural check: header, cross-reference pointer and end mark; no PDF parser is at hand."""
    if not re.match(rb"%PDF-\d", payload[payload[:1024].find(b"%PDF-") if b"%PDF-" in payload[:1024] else 0 :]) or b"startxref" not in payload or b"%%EOF" not in payload[-2048:]:
        return Kind("application/pdf", "archives/unprocessed", ".pdf", "parser", reason="corrupt_pdf")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", payload):
        return Kind("application/pdf", "archives/unprocessed", ".pdf", "parser", reason="encrypted_pdf")
    return Kind("application/pdf", "pdf", ".pdf", "parser")


def is_json(payload: bytes) -> bool:
    if payload[:1] not in (b"{", b"["):
        return False
    try:
        json.loads(payload.decode())
    except (ValueError, RecursionError):
        return False
    return True


def identify(payload: bytes, name: str) -> Kind:
    suffix = PurePosixPath(name).suffix.casefold()
    if payload.startswith((b"Rar!\x1a\x07\0", b"Rar!\x1a\x07\1\0")):
        return Kind("application/vnd.rar", "archives/unprocessed", ".rar", "signature", reason="unsupported_rar")
    if payload.startswith(b"7z\xbc\xaf\x27\x1c"):
        return Kind("application/x-7z-compressed", "other", ".7z", "signature", container="7z")
    if payload.startswith((b"PK\3\4", b"PK\5\6")):
        return package(payload) or Kind("application/zip", "other", ".zip", "structure", container="zip")
    if is_tar(payload, name):
        return Kind("application/x-tar", "other", ".tar", "structure", container="tar")
    if payload.startswith(b"%PDF-") or suffix == ".pdf":
        return pdf(payload)
    for at, mark, media, group, ext in MAGIC:
        if payload[at : at + len(mark)] == mark:
            return Kind(media, group, ext, "signature")
    if is_json(payload):
        return Kind("application/json", "data", ".json", "structure")
    if len(payload) >= 12 and payload[4:8] == b"ftyp":
        return Kind("video/mp4", "video", ".mp4", "signature")
    if payload[:4] == b"RIFF" and payload[8:12] == b"WAVE":
        return Kind("audio/wav", "audio", ".wav", "signature")
    if suffix in EXTENSIONS:
        return Kind(*EXTENSIONS[suffix], "extension")
    return Kind("application/octet-stream", "other", PurePosixPath(name).suffix or ".bin", "unknown")


def kind_of(payload: Column, name: Column) -> Column:
    """``identify`` of binary values and their names, as a struct."""

    @F.pandas_udf("struct<media_type:string,group:string,extension:string,method:string,container:string,reason:string>")
    def run(payloads: pd.Series, names: pd.Series) -> pd.DataFrame:
        found = [identify(p or b"", n)[:6] for p, n in zip(payloads, names)]
        return pd.DataFrame(found, columns=["media_type", "group", "extension", "method", "container", "reason"], dtype=object)

    return run(payload, name)
