"""Configuration of the application and of linting: small files, read and written by the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from folio.operators.lint import RULES
from folio.operators.publish import POLICIES

# Defaults.
PROMPT = "Translate the markdown to {TARGET_LANG} as a native speaker - preserve code/YAML/links/cli commands (e.g. `kubectl apply` or `pip install langchain`) and tech terms (CRDs, Helm charts, RAG). Output ONLY fluently localized text with natural technical phrasing that doesn't read machine-generated."
ENDPOINT, MODEL = "https://api.openai.com/v1", "gpt-3.5-turbo"
LINT_CONFIG_NAMES = (".markdownlint.json", ".markdownlint.jsonc", ".markdownlintrc", ".markdownlintrc.json", ".markdownlintrc.jsonc")


@dataclass(frozen=True)
class Storage:
    provider: str = ""
    region: str = "auto"
    endpoint: str = ""
    access_key: str = ""
    secret_key: str = ""
    bucket: str = ""
    account_id: str = ""
    custom_domain: str = ""
    path_prefix: str = ""
    provider_opts: dict = field(default_factory=dict)
    concurrency: int = 5
    skip_verify: bool = False
    ca_cert_path: str = ""
    conflict_policy: str = "rename"
    cache_dir: str = ""


@dataclass(frozen=True)
class Config:
    translate_prompt: str = PROMPT
    endpoint: str = ENDPOINT
    api_key: str = ""
    model: str = MODEL
    temperature: float = 0.0
    top_p: float = 1.0
    cloud_storages: dict[str, Storage] = field(default_factory=dict)
    default_storage: str = ""

    def active_storage(self, name: str = "") -> Storage:
        """The named storage, else the default one, else the first by name, else built-in defaults."""
        for n in (name, self.default_storage, *sorted(self.cloud_storages)):
            if n in self.cloud_storages:
                return self.cloud_storages[n]
        return Storage()

    def shown(self) -> dict:
        """As JSON values, secrets masked."""
        out = asdict(self)
        mask = lambda v: v and "***"
        out["api_key"] = mask(out["api_key"])
        for s in out["cloud_storages"].values():
            s["access_key"], s["secret_key"] = mask(s["access_key"]), mask(s["secret_key"])
        return out

    def get(self, key: str):
        key = key.strip()
        if key.lower().startswith("cloud_storages."):
            _, name, *rest = key.split(".", 2)
            if name not in self.cloud_storages:
                raise KeyError(f"storage not found: {name}")
            store = self.cloud_storages[name]
            if not rest:
                return asdict(store)
            return getattr(store, _known(Storage, rest[0]))
        return getattr(self, _known(Config, key))

    def set(self, key: str, value: str) -> Config:
        if not key or not value:
            raise ValueError("key and value are required")
        if key.lower().startswith("cloud_storages."):
            parts = key.split(".", 2)
            if len(parts) != 3:
                raise ValueError(f"invalid config key format: {key}")
            name, item = parts[1], _known(Storage, parts[2])
            store = self.cloud_storages.get(name, Storage())
            if item == "concurrency":
                value = int(value)
            elif item == "skip_verify":
                value = value.lower() == "true"
            elif item == "provider_opts":
                raise KeyError(f"unknown cloud storage configuration key: {item}")
            elif item == "conflict_policy":
                value = value.lower()
                if value not in POLICIES:
                    raise ValueError(f"invalid conflict policy: {value} (must be {', '.join(POLICIES)})")
            storages = {**self.cloud_storages, name: replace(store, **{item: value})}
            default = self.default_storage or (name if len(storages) == 1 else "")
            return replace(self, cloud_storages=storages, default_storage=default)
        item = _known(Config, key)
        if item in {"cloud_storages", "default_storage"}:
            raise KeyError(f"unknown configuration key: {key}")
        return replace(self, **{item: float(value) if item in {"temperature", "top_p"} else value})

    def with_default(self, name: str) -> Config:
        if name not in self.cloud_storages:
            raise KeyError(f"storage not found: {name}")
        return replace(self, default_storage=name)

    def with_known_default(self) -> Config:
        """With the first storage by name as the default where that is unset or unknown."""
        if self.default_storage in self.cloud_storages or not self.cloud_storages:
            return self
        return replace(self, default_storage=min(self.cloud_storages))

    def storages(self) -> list[tuple[str, bool]]:
        """Names in order, and whether each is the default."""
        return [(n, n == self.default_storage) for n in sorted(self.cloud_storages)]


def _known(cls, name: str) -> str:
    low = name.lower()
    if low not in {f.name for f in fields(cls)}:
        raise KeyError(f"unknown configuration key: {name}")
    return low


def save(config: Config, path: str | os.PathLike) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(config), indent=2, ensure_ascii=False), encoding="utf-8")


def load(path: str | os.PathLike) -> tuple[Config, str | None]:
    """The configuration, and what was wrong with the file. A missing one is written with defaults, an unreadable one replaced by them."""
    path = Path(path)
    if not path.exists():
        save(Config(), path)
        return Config(), None
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
        names = {f.name for f in fields(Storage)}
        storages = {n: Storage(**{k: v for k, v in s.items() if k in names}) for n, s in (raw.get("cloud_storages") or {}).items()}
        known = {f.name for f in fields(Config)} - {"cloud_storages"}
        config = Config(**{k: v for k, v in raw.items() if k in known}, cloud_storages=storages)
    except (ValueError, AttributeError, TypeError) as e:
        path.unlink()
        save(Config(), path)
        return Config(), f"invalid config file (recreated with defaults): {e}"
    blank = {k: v for k, v in (("translate_prompt", PROMPT), ("endpoint", ENDPOINT), ("model", MODEL)) if not getattr(config, k)}
    if config.default_storage not in storages:
        blank["default_storage"] = min(storages, default="")
    return replace(config, **blank), None


def find_lint_config(folders=(".", "~")) -> Path | None:
    return next((p for d in folders for n in LINT_CONFIG_NAMES if (p := Path(d).expanduser() / n).exists()), None)


def parse_lint_config(text: str) -> dict[str, bool]:
    """Which rules the text of a lint configuration turns on or off. A text that cannot be read as such counts for nothing as a whole.

    ``default``, ``extends`` and ``options`` are accepted and have no effect.
    """
    try:
        raw, out = json.loads(text), {}
        for rule in RULES:
            own = raw.get(rule)
            if own is None:
                continue
            enabled = own.get("enabled")
            if enabled is not None and not isinstance(enabled, bool) or not isinstance(own.get("options", {}), dict):
                return {}
            if enabled is not None:
                out[rule] = enabled
        return out if isinstance(raw.get("default", True), bool) and isinstance(raw.get("extends", ""), str) else {}
    except (ValueError, AttributeError):
        return {}


def load_lint_config(path: str | None = None, folders=(".", "~")) -> dict[str, bool]:
    """``parse_lint_config`` of the given file or the first that is found; without one that can be read, nothing."""
    found = Path(path) if path else find_lint_config(folders)
    try:
        return parse_lint_config(found.read_text(encoding="utf-8")) if found else {}
    except (OSError, ValueError):
        return {}


def default_lint_config() -> str:
    return json.dumps({"default": True, **{r: {"enabled": True} for r in RULES}}, indent=2)


def write_lint_config(path: str) -> None:
    Path(path).write_text(default_lint_config(), encoding="utf-8")
