"""Settings in TOML over defaults, and registries of catalogues, engines and agents in which a user's entry replaces a built-in one."""

from __future__ import annotations

import os
import re
import tomllib
from copy import deepcopy
from typing import Any

#: The defaults.
DEFAULTS: dict[str, Any] = {
    "relevance": {"review_at": 30, "confirmed_at": 70},
    "agent": {"max_queries": 16, "hits_per_query": 8, "max_pages": 40, "max_depth": 2, "per_host": 6, "max_rounds": 2, "max_files": 40, "search_keys": {}},
    "online": {"max_files_per_record": 25, "max_download_mb": 500, "parallel_downloads": 3, "timeout": 30, "results_per_provider": 25, "min_download_score": 50},
    "scan": {"max_file_size_mb": 4096, "content": False, "content_max_mb": 20},
    "dedup": {"fuzzy": True, "threshold": 0.85},
    "extraction": {"enabled": True, "max_text_mb": 50},
    "archives": {"ingest_members": False},
}
KINDS = {"catalogue": ("lookup", "api_json", "html_links", "python"), "engine": ("json", "rss", "html")}


def merged(base: dict, over: dict) -> dict:
    """base with over on top, tables merged at every depth; neither is changed."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def load(path: str | None = None) -> dict:
    if not path or not os.path.exists(path):
        return deepcopy(DEFAULTS)
    with open(path, "rb") as f:
        return merged(DEFAULTS, tomllib.load(f))


def problems(entry: dict, kind: str) -> list[str]:
    """What is wrong with an entry of a registry; nothing if it can be used. Tools need a name and a command alone."""
    if kind == "tool":
        good = re.fullmatch(r"[a-z0-9_-]+", str(entry.get("name", ""))) and entry.get("command")
        return [] if good else ["a name of small letters, digits, _ and - and a command are required"]
    out = [] if re.fullmatch(r"[a-z0-9_-]+", str(entry.get("name", ""))) else ["a name of small letters, digits, _ and - is required"]
    mode = entry.get("mode" if kind == "catalogue" else "kind", "lookup" if kind == "catalogue" else "html")
    if mode not in KINDS[kind]:
        out.append(f"must be one of {', '.join(KINDS[kind])}, not {mode}")
    if mode != "python" and "url" not in entry:
        out.append("a url is required")
    for k in ("link_pattern", "download_pattern", "blocked_pattern"):
        try:
            re.compile(entry.get(k, ""))
        except re.error as e:
            out.append(f"{k}: {e}")
    return out


def registry(kind: str, *sources: list[dict], disabled: tuple[str, ...] = ()) -> tuple[dict[str, dict], dict[str, list[str]]]:
    """Usable entries by name, later sources replacing earlier ones, and the problems of the others."""
    good: dict[str, dict] = {}
    bad: dict[str, list[str]] = {}
    for source in sources:
        for entry in source:
            name = str(entry.get("name", "?"))
            if found := problems(entry, kind):
                bad[name] = found
            else:
                good[name] = {**entry, "enabled": name not in disabled}
    return good, bad


def usable(engine: dict, keys: dict[str, str], environment: dict[str, str] | None = None) -> str | None:
    """Why an engine can't be used: the key or id that it lacks; None if it can."""
    environment = os.environ if environment is None else environment
    held = lambda name: keys.get(name) or environment.get(f"VERBENA_SEARCH_KEY_{name.upper()}")
    if engine.get("needs_key") and not held(engine["name"]):
        return "needs a key"
    if engine.get("needs_cx") and not held(f"{engine['name']}_cx"):
        return "needs an id (cx)"
    return None


def available(provider: dict, code: str | None) -> bool:
    return bool(code) or not provider.get("needs_code")


def to_toml(table: dict, name: str = "") -> str:
    """A table as TOML, plain values first."""
    import json

    lines = [f"[{name}]"] if name else []
    lines += [f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in table.items() if not isinstance(v, dict)]
    parts = ["\n".join(lines)] if lines else []
    parts += [to_toml(v, f"{name}.{k}" if name else k) for k, v in table.items() if isinstance(v, dict)]
    return "\n\n".join(p for p in parts if p)


def write_key(path: str, section: str, key: str, value: Any) -> None:
    """Set one value in a TOML file, which is made if there is none."""
    current: dict = {}
    if os.path.exists(path):
        with open(path, "rb") as f:
            current = tomllib.load(f)
    at = current
    for part in section.split("."):
        at = at.setdefault(part, {})
    at[key] = value
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(to_toml(current) + "\n")
    os.replace(f"{path}.new", path)


def listing(entries: dict[str, dict], order: list[str], keys: dict[str, str], environment: dict[str, str] | None = None) -> list[dict]:
    """Engines for people: those in use first, in the order set, then the others by name, with what each lacks."""
    place = {n: i for i, n in enumerate(order)}
    rows = [{"name": n, "kind": e.get("kind"), "enabled": n in place and e.get("enabled", True), "why": usable(e, keys, environment) or "", "order": place.get(n)} for n, e in entries.items()]
    return sorted(rows, key=lambda r: (r["order"] is None, r["order"] or 0, r["name"]))


def add_entry(path: str, kind: str, entry: dict) -> None:
    """Write a user's entry to its registry's file; one that can't be used is refused."""
    if found := problems(entry, kind):
        raise ValueError("; ".join(found))
    write_key(path, kind, entry["name"], {k: v for k, v in entry.items() if k != "name"})


def remove_entry(path: str, kind: str, name: str) -> bool:
    """Take a user's entry out of its file; whether it was there."""
    if not os.path.exists(path):
        return False
    with open(path, "rb") as f:
        current = tomllib.load(f)
    if name not in current.get(kind, {}):
        return False
    del current[kind][name]
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(to_toml(current) + "\n")
    os.replace(f"{path}.new", path)
    return True


def entries_of(path: str, kind: str) -> list[dict]:
    """A user's entries, as registry() takes them."""
    if not os.path.exists(path):
        return []
    with open(path, "rb") as f:
        return [{"name": n, **e} for n, e in tomllib.load(f).get(kind, {}).items()]
