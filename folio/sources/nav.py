"""Site navigation, flattened on the driver to rows that are joined with documents."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ord int, title_path array<string>, file string"
#: Names of site configurations, in order of preference.
CONFIG_NAMES = ("mkdocs.yml", "mkdocs.yaml")


class _Loader:
    """YAML with unknown tags read as plain values."""

    def __new__(cls):
        import yaml

        class Lenient(yaml.SafeLoader):
            pass

        Lenient.add_multi_constructor("!", lambda loader, suffix, node: None)
        Lenient.add_multi_constructor("tag:", lambda loader, suffix, node: None)
        return Lenient


def find_config(root: str) -> Path | None:
    return next((p for n in CONFIG_NAMES if (p := Path(root) / n).exists()), None)


def read_config(path: Path, seen: tuple[Path, ...] = ()) -> dict:
    """A configuration over those it inherits from, key by key at the top level; a cycle is an error."""
    import yaml

    path = path.resolve()
    if path in seen:
        raise ValueError(f"configurations inherit from each other: {path}")
    own = yaml.load(path.read_text(encoding="utf-8"), _Loader()) or {}
    parent = own.pop("INHERIT", None)
    if parent is None:
        return own
    if not isinstance(parent, str):
        raise ValueError("INHERIT must be a string")
    return read_config(path.parent / parent, (*seen, path)) | own


def flatten(nav, exists: Callable[[str], bool], wanted: tuple[str, ...] = (), titles: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """``(titles, file)`` of the pages of a navigation tree; with ``wanted``, only of branches whose titles begin so, level by level."""
    if isinstance(nav, list):
        for item in nav:
            yield from flatten(item, exists, wanted, titles)
    elif isinstance(nav, dict):
        for title, below in nav.items():
            name = str(title).strip()
            if wanted and name != wanted[0].strip():
                continue
            if isinstance(below, str) and len(wanted) <= 1:
                yield from flatten(below, exists, (), (*titles, name))
            else:
                yield from flatten(below, exists, wanted[1:], (*titles, name))
    elif isinstance(nav, str) and not wanted and nav.endswith(".md") and exists(nav):
        yield titles, nav


def read_nav(spark: SparkSession, root: str, nav_path: str = "") -> DataFrame:
    """``ord, title_path, file`` of a site; without navigation all Markdown files of its folder, by path."""
    config = find_config(root)
    if config is None:
        raise FileNotFoundError(f"no site configuration in {root}")
    site = read_config(config)
    base = Path(root) / str(site.get("docs_dir") or "docs")
    if site.get("nav"):
        wanted = tuple(p for p in nav_path.split("/") if p) if nav_path else ()
        rows = [(list(t), posixpath.join(str(base), f)) for t, f in flatten(site["nav"], lambda f: (base / f).exists(), wanted)]
    else:
        rows = [([], str(p)) for p in sorted(base.rglob("*")) if p.suffix.lower() in {".md", ".markdown"}]
    return spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(rows)], SCHEMA)


def site_files(spark: SparkSession, kind: str, root: str, nav_path: str = "") -> DataFrame:
    if kind == "mkdocs":
        return read_nav(spark, root, nav_path)
    if kind in {"hugo", "docusaurus"}:
        raise NotImplementedError(f"{kind} is not yet implemented")
    raise ValueError(f"unsupported site type: {kind}")


def in_order(docs: DataFrame, nav: DataFrame, path: str = "path") -> DataFrame:
    """Documents of the navigation with ``ord``; a document listed twice comes twice."""
    return nav.select("ord", F.col("file").alias(path)).join(docs, path)
