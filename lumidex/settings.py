"""Settings of the collection operators, and their tolerant JSON form."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

# Suffixes of pictures, and of raw files, which are read only if asked for.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".heic", ".heif", ".avif", ".ppm", ".pgm", ".tga", ".ico")
RAW_EXTENSIONS = (".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf", ".pef", ".srw")
#: What settings take: the least and most of numbers, the choices of names.
RANGES = {"phash_threshold": (0, 64), "dhash_threshold": (0, 64), "color_threshold": (0, 1), "min_file_bytes": (0, 2**63 - 1), "export_max_edge": (0, 2**31 - 1)}
CHOICES = {"import_mode": ("copy", "move"), "import_organise": ("flat", "date", "source"), "export_mode": ("copy", "move", "symlink"), "export_naming": ("original", "rank", "score", "date"), "export_manifest": ("none", "csv", "json")}
#: Other names by which a settings file can call a key.
_ALSO = {"similarity_threshold": "phash_threshold", "detect_rotations": "match_rotations", "group_exact_duplicates": "group_exact"}


def _fits(name: str, value) -> bool:
    low, high = RANGES.get(name, (value, value))
    return value in CHOICES.get(name, (value,)) and low <= value <= high


METRICS = ["sharpness", "exposure", "contrast", "colorfulness", "noise", "resolution", "detail"]


@dataclass(frozen=True)
class Weights:
    """How much each metric counts in a score."""

    sharpness: float = 3.0
    exposure: float = 2.0
    contrast: float = 1.5
    colorfulness: float = 1.0
    noise: float = 1.5
    resolution: float = 1.5
    detail: float = 1.0

    def normalised(self) -> dict[str, float]:
        """Shares that sum to 1; negative weights count as 0, and all-zero weights share evenly."""
        kept = {m: max(0.0, float(getattr(self, m))) for m in METRICS}
        total = sum(kept.values())
        return {m: v / total for m, v in kept.items()} if total > 0 else {m: 1 / len(METRICS) for m in METRICS}


@dataclass(frozen=True)
class Settings:
    weights: Weights = field(default_factory=Weights)
    phash_threshold: int = 10
    dhash_threshold: int = 16
    color_threshold: float = 0.28
    match_rotations: bool = False
    group_exact: bool = True
    prefer_larger_on_tie: bool = True
    library_root: str = ""
    watched_folders: tuple[str, ...] = ()
    min_file_bytes: int = 4096
    include_raw: bool = False
    include_hidden: bool = False
    follow_symlinks: bool = False
    import_mode: str = "copy"
    import_organise: str = "date"
    import_skip_exact: bool = True
    import_skip_similar: bool = False
    export_mode: str = "copy"
    export_naming: str = "original"
    export_manifest: str = "csv"
    export_group_folders: bool = False
    export_max_edge: int = 0

    @property
    def extensions(self) -> tuple[str, ...]:
        return IMAGE_EXTENSIONS + RAW_EXTENSIONS if self.include_raw else IMAGE_EXTENSIONS

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Unknown keys, keys of the wrong type, values out of their range and text that is no JSON object leave the defaults."""
        try:
            given = json.loads(text)
        except ValueError:
            return cls()
        if not isinstance(given, dict):
            return cls()
        given = {_ALSO.get(k, k): v for k, v in given.items()}
        base, found = cls(), {}
        for f in fields(cls):
            value = given.get(f.name)
            if f.name == "weights" and isinstance(value, dict):
                found["weights"] = Weights(**{k: float(v) for k, v in value.items() if k in METRICS and isinstance(v, (int, float)) and not isinstance(v, bool)})
            elif f.name == "watched_folders" and isinstance(value, list):
                found[f.name] = tuple(str(x) for x in value)
            elif f.name in given and f.name not in ("weights", "watched_folders"):
                default = getattr(base, f.name)
                kind = isinstance(value, bool) == isinstance(default, bool) and isinstance(value, (type(default), int) if isinstance(default, float) else type(default))
                if kind and _fits(f.name, value):
                    found[f.name] = type(default)(value)
        return cls(**found)

    def save(self, path: str) -> None:
        """Written beside the target and moved over it, so that a reader never sees half a file."""
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            f.write(self.to_json())
        os.replace(f"{path}.tmp", path)

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path, encoding="utf-8") as f:
                return cls.from_json(f.read())
        except OSError:
            return cls()
