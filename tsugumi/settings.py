"""Settings of an engine: environment over files over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

from tsugumi import params as P

#: Settings that only a restart takes up.
STRUCTURAL = ("root", "state", "extensions", "use_gitignore", "directories", "dimension", "fallback")


@dataclass(frozen=True)
class Directory:
    path: str
    weight: float = 1.0
    half_life_days: float = P.DEFAULT_HALF_LIFE_DAYS


@dataclass(frozen=True)
class Settings:
    root: str = "."
    state: str = "index"
    extensions: tuple[str, ...] = ("md",)
    use_gitignore: bool = True
    directories: tuple[Directory, ...] = ()
    dimension: int = 64
    fallback: str = "error"
    top_k: int = 5
    dictionary_threshold: int = P.DICTIONARY_THRESHOLD
    chunk_bytes: int = P.MAX_CHUNK_BYTES
    dictionary: str = ""  # file of the user's dictionary, surface,POS,reading
    stopwords: str = ""  # file of words that are not searched for
    status: str = ""  # file that tells how far a long operation is

    @property
    def weights(self) -> dict[str, float]:
        return {d.path: d.weight for d in self.directories}

    @property
    def half_lives(self) -> dict[str, float]:
        return {d.path: d.half_life_days for d in self.directories}


def _directories(items) -> tuple[Directory, ...]:
    """Relative, non-empty directories, the longest first; weights and half-lives that make no sense give way to the defaults."""
    out = []
    for x in items if isinstance(items, list) else []:
        x = {"path": x} if isinstance(x, str) else x
        path = str(x.get("path", "")).strip().rstrip("/")
        if not path or PurePosixPath(path).is_absolute():
            continue
        number = lambda k, least, default: float(x[k]) if isinstance(x.get(k), (int, float)) and x[k] > least else default  # noqa: B023, E731
        out.append(Directory(path, number("weight", -1e-12, 1.0), number("half_life_days", 0, P.DEFAULT_HALF_LIFE_DAYS)))
    return tuple(sorted(out, key=lambda d: (-len(d.path), d.path)))


def fallback_mode(text: str) -> str:
    """``error`` or ``fts_only`` (also written fts-only); ValueError for anything else."""
    mode = text.strip().lower().replace("-", "_")
    if mode not in ("error", "fts_only"):
        raise ValueError(f"unknown fallback: {text!r}")
    return mode


def resolve(paths: list[str] = (), environment: dict[str, str] | None = None, prefix: str = "TSUGUMI_") -> Settings:
    """The settings of the TOML files in ``paths``, the first that names a field winning, with the environment before all. Files that are missing or can't be parsed are passed over."""
    environment = dict(os.environ) if environment is None else environment
    files = []
    for p in paths:
        try:
            with open(p, "rb") as f:
                files.append(tomllib.load(f))
        except (OSError, tomllib.TOMLDecodeError):
            pass
    got = {}
    for f in fields(Settings):
        named = environment.get(prefix + f.name.upper())
        value = named if named not in (None, "") else next((x[f.name] for x in files if x.get(f.name) is not None), None)
        if value is None:
            continue
        if f.name == "directories":
            got[f.name] = _directories(value.split(",") if isinstance(value, str) else value)
        elif f.name == "extensions":
            got[f.name] = tuple(v.strip() for v in (value.split(",") if isinstance(value, str) else value) if v.strip())
        elif f.name == "fallback":
            got[f.name] = fallback_mode(str(value))
        elif f.name == "use_gitignore":
            got[f.name] = str(value).lower() in ("1", "true", "yes")
        else:
            got[f.name] = type(f.default)(value)
    return Settings(**got)


def reload_warnings(old: Settings, new: Settings) -> list[str]:
    """Changed settings that only a restart takes up."""
    return [f"{name} changed from {getattr(old, name)!r} to {getattr(new, name)!r}; restart to apply" for name in STRUCTURAL if getattr(old, name) != getattr(new, name)]
