"""Values stated once: navigation, the converter's arguments, configuration; plain functions of the driver, so no queries."""

from dataclasses import replace

import pytest

from folio.operators import lint, translate
from folio.sources import config, nav, pandoc

STATED = {}


def _stated(name, columns, wanted, got):
    STATED[name] = (wanted, got)


# -- navigation and conversion ---------------------------------------------------------------------------------------------------
_TREE = ["index.md", {"Guide ": ["guide/a.md", {"Deep": [{"Leaf": "guide/deep/leaf.md"}, "guide/gone.md", "guide/note.txt"]}, {"B": "guide/b.md"}]}, {"Ref": "ref.md"}, {"Other": [{"Deep": "other/deep.md"}]}]


def _flat(wanted: tuple[str, ...] = ()) -> list[tuple]:
    return [(i, "/".join(t), f) for i, (t, f) in enumerate(nav.flatten(_TREE, lambda f: "gone" not in f, wanted))]


_NAV = "ord long, titles string, file string"
_stated("nav_flatten", _NAV, [(0, "", "index.md"), (1, "Guide", "guide/a.md"), (2, "Guide/Deep/Leaf", "guide/deep/leaf.md"), (3, "Guide/B", "guide/b.md"), (4, "Ref", "ref.md"), (5, "Other/Deep", "other/deep.md")], _flat)
_stated("nav_flatten_branch", _NAV, [(0, "Guide/Deep/Leaf", "guide/deep/leaf.md")], lambda: _flat(("Guide", " Deep")))
_stated("nav_flatten_leaf", _NAV, [(0, "Ref", "ref.md")], lambda: _flat(("Ref",)))


def _arguments(**options) -> list[tuple]:
    return list(enumerate(pandoc.arguments("m/merged.md", "out/x", "/w", pandoc.ExportOptions(**options), ["docs"])))


_BASE = ["m/merged.md", "-o", "out/x", "--standalone", "--pdf-engine=xelatex", "-V", "mainfont=SimSun", "--wrap=preserve", "--embed-resources", "--resource-path", "/w", "--resource-path", "docs", "--resource-path", "m", "--resource-path", "out"]
for _name, _options, _more in (
    ("docx", {"template": "t.docx", "toc": True, "shift": 1}, ["--reference-doc", "t.docx", "--toc", "--toc-depth", "3", "--shift-heading-level-by", "1"]),
    ("pdf", {"format": "pdf"}, ["-V", "CJKmainfont=SimSun", "-V", "documentclass=article", "-V", "geometry=margin=1in"]),
    ("epub", {"format": "epub", "toc": True, "toc_depth": 0}, ["--toc", "--epub-chapter-level=1"]),
):
    _stated(f"converter_arguments_{_name}", "pos long, argument string", list(enumerate(_BASE + _more)), lambda o=_options: _arguments(**o))

# -- configuration ---------------------------------------------------------------------------------------------------------------
_CHANGES = [("API_KEY", "k1"), ("temperature", "0.5"), ("cloud_storages.one.provider", "r2"), ("cloud_storages.one.access_key", "a1"), ("cloud_storages.two.concurrency", "9"), ("cloud_storages.two.conflict_policy", "VERSION"), ("cloud_storages.two.skip_verify", "TRUE")]


def _configured() -> config.Config:
    out = config.Config()
    for key, value in _CHANGES:
        out = out.set(key, value)
    return out


def _tried(change) -> str:
    try:
        return str(change())
    except (KeyError, ValueError) as e:
        return type(e).__name__


_GET = [("api_key", "k1"), ("Temperature", "0.5"), ("top_p", "1.0"), ("cloud_storages.one.provider", "r2"), ("cloud_storages.one.region", "auto"), ("cloud_storages.two.Concurrency", "9"), ("cloud_storages.two.conflict_policy", "version"), ("cloud_storages.two.skip_verify", "True"), ("default_storage", "one"), ("cloud_storages.gone.region", "KeyError"), ("nothing", "KeyError")]
_stated("config_get", "key string, value string", _GET, lambda: [(k, _tried(lambda: _configured().get(k))) for k, _ in _GET])
_SET = [("model", "m", "m"), ("top_p", "0.25", "0.25"), ("top_p", "x", "ValueError"), ("cloud_storages.one.concurrency", "x", "ValueError"), ("cloud_storages.one.conflict_policy", "keep", "ValueError"), ("cloud_storages.one", "x", "ValueError"), ("nothing", "x", "KeyError"), ("default_storage", "one", "KeyError"), ("cloud_storages.one.bucket", "b", "b"), ("", "x", "ValueError")]
_stated("config_set", "key string, given string, value string", _SET, lambda: [(k, v, _tried(lambda: _configured().set(k, v).get(k))) for k, v, _ in _SET])
_LIST = [("api_key", "***"), ("one.access_key", "***"), ("one.secret_key", ""), ("two.access_key", ""), ("model", config.MODEL), ("endpoint", config.ENDPOINT)]
_stated("config_list", "key string, shown string", _LIST, lambda: [(k, (lambda c: c["cloud_storages"][k.split(".")[0]][k.split(".")[1]] if "." in k else c[k])(_configured().shown())) for k, _ in _LIST])
_stated("config_storages", "name string, is_default boolean", [("one", False), ("two", True)], lambda: _configured().with_default("two").storages())
_ACTIVE = [("two", "9"), ("", "5"), ("gone", "5")]
_stated("config_active_storage", "name string, concurrency string", _ACTIVE, lambda: [(n, str(_configured().active_storage(n).concurrency)) for n, _ in _ACTIVE])
_DEFAULTS = [("", "one"), ("gone", "one"), ("two", "two")]
_stated("config_known_default", "given string, found string", _DEFAULTS, lambda: [(n, replace(_configured(), default_storage=n).with_known_default().default_storage) for n, _ in _DEFAULTS])
_LINT_CONFIGS = [('{"MD013": {"enabled": false}, "MD009": {"enabled": true}, "default": false}', "MD009=True MD013=False"), ('{"MD013": false, "MD009": {"enabled": false}}', ""), ('{"MD013": {"enabled": "no"}}', ""), ('{"MD013": {"options": {"length": 10}}, "extends": "x"}', ""), ("[]", ""), ("{", ""), ('{"MD999": {"enabled": false}, "MD001": {"enabled": false}}', "MD001=False")]
_stated("lint_config_quirks", "text string, rules string", _LINT_CONFIGS, lambda: [(t, " ".join(f"{k}={v}" for k, v in sorted(config.parse_lint_config(t).items()))) for t, _ in _LINT_CONFIGS])
_stated("lint_config_default", "rule string, enabled boolean", [(r, True) for r in lint.RULES], lambda: sorted(config.parse_lint_config(config.default_lint_config()).items()))



@pytest.mark.parametrize("name", STATED)
def test_stated(name):
    wanted, got = STATED[name]
    assert [tuple(r) for r in got()] == wanted


def test_tables_of_values(spark):
    assert {r["code"]: r["name"] for r in translate.languages(spark).collect()} == translate.LANGUAGES
    assert sorted(lint.RULES) == list(lint.RULES)
