"""Finding dataset files."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterable, Mapping
from pathlib import Path

from geolith.errors import UnsupportedFormatError

# What a folder is searched for, of which .gml and .kml have no reader, and the ceilings of an upload.
SUFFIXES = (".gpkg", ".shp", ".geojson", ".json", ".parquet", ".geoparquet", ".fgb", ".gml", ".kml")
MOST_BYTES, MOST_FEATURES, MOST_REPAIRED = 100 * 1024 * 1024, 1_000_000, 50_000
SHAPEFILE_PARTS = (".shp", ".shx", ".dbf")


def discover(inputs: Iterable[str | Path], recursive: bool = False, suffixes: Iterable[str] = SUFFIXES) -> list[Path]:
    """The dataset files among files and folders: resolved, each once, sorted by case-folded path.

    A path that does not exist and a named file of another suffix raise; other files in folders are passed over.
    """
    wanted = {s.lower() if s.startswith(".") else "." + s.lower() for s in suffixes}
    if not wanted:
        raise ValueError("there must be a suffix")
    found = set()
    for item in map(Path, inputs):
        if item.is_dir():
            found |= {p.resolve() for p in (item.rglob("*") if recursive else item.iterdir()) if p.is_file() and p.suffix.lower() in wanted}
        elif not item.exists():
            raise FileNotFoundError(str(item))
        elif item.suffix.lower() not in wanted:
            raise UnsupportedFormatError(str(item))
        else:
            found.add(item.resolve())
    return sorted(found, key=lambda p: str(p).casefold())


def check_bundle(names: Iterable[str]) -> None:
    """Whether files can be one dataset: one to five plain names, and for a Shapefile all parts of one stem."""
    names = list(names)
    if not 1 <= len(names) <= 5:
        raise ValueError("a dataset has one to five files")
    for n in names:
        if not n or n in (".", "..") or any(c in n for c in "/\\\0"):
            raise ValueError(f"not a plain file name: {n!r}")
    paths = [Path(n) for n in names]
    have = {p.suffix.lower() for p in paths}
    if ".shp" in have or len(names) > 1:
        if missing := [s for s in SHAPEFILE_PARTS if s not in have]:
            raise ValueError(f"the Shapefile lacks {', '.join(missing)}")
        if len({p.stem for p in paths}) > 1:
            raise ValueError("the parts of a Shapefile have one stem")


def decode_bundle(files: Mapping[str, str]) -> dict[str, bytes]:
    """The bytes of a dataset's files given in base64, after check_bundle and the ceiling on bytes. Text that is no base64 raises ValueError."""
    check_bundle(files)
    out = {}
    for name, text in files.items():
        try:
            out[name] = base64.b64decode(text, validate=True)
        except (binascii.Error, TypeError) as error:
            raise ValueError(f"{name} is no base64") from error
    check_ceilings(sum(map(len, out.values())), None)
    return out


def check_ceilings(size: int, features: int | None, repair: bool = False) -> None:
    """Raise ValueError for a dataset over the ceilings of bytes or features; repair has a lower one of its own."""
    if size > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes")
    most = MOST_REPAIRED if repair else MOST_FEATURES
    if features is not None and features > most:
        raise ValueError(f"more than {most} features")
