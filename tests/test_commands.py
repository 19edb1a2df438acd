import json

import pytest

from folio.__main__ import main, parser


def test_lint_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("#Title\n\nText.\n")
    (tmp_path / "b.md").write_text("# Fine\n")
    assert main(["lint", f"{tmp_path}/*.md"]) == 1
    assert "✗ Line 1: No space after hash" in capsys.readouterr().out
    assert main(["lint", "--format", "json", f"{tmp_path}/a.md", f"{tmp_path}/none.md"]) == 1
    out = capsys.readouterr()
    assert json.loads(out.out)["issues"][0]["rule"] == "MD018" and "none.md" in out.err
    assert main(["lint", "--format", "github", "--disable", "MD018", f"{tmp_path}/a.md"]) == 0
    assert main(["lint", "--fix", f"{tmp_path}/a.md"]) == 0
    assert (tmp_path / "a.md").read_text() == "#Title\n\nText.\n" and (tmp_path / "a.md.fixed").read_text() == "# Title\n\nText.\n"
    assert main(["lint", "--init"]) == 0 and (tmp_path / ".markdownlint.json").exists()


def test_config_command(tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("folio.__main__.CONFIG", str(tmp_path / "c.json"))
    assert main(["config", "set", "model", "m2"]) == 0
    assert main(["config", "get", "model"]) == 0
    assert capsys.readouterr().out == "m2\n"
    main(["config", "set", "cloud_storages.a.bucket", "b"])
    main(["config", "list-storages"])
    assert capsys.readouterr().out == "a (default)\n"
    with pytest.raises(KeyError):
        main(["config", "set-default-storage", "zz"])


def test_upload_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("folio.__main__.CONFIG", str(tmp_path / "c.json"))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("![x](i.png)")
    (docs / "i.png").write_bytes(b"1")
    assert main(["upload", str(docs), "--store", str(tmp_path / "store")]) == 0
    assert json.loads(capsys.readouterr().out)["uploaded"] == 1
    assert "https://" in (docs / "a.md.uploaded").read_text()
    assert main(["upload", str(docs), "--store", str(tmp_path / "store")]) == 0
    assert json.loads(capsys.readouterr().out)["skipped"] == 1


def test_corrupt_cache(spark, tmp_path):
    from folio.sources.stores import read_cache

    (tmp_path / "c.json").write_text("{broken")
    assert read_cache(spark, str(tmp_path / "c.json")).count() == 0
    assert read_cache(spark, str(tmp_path / "none.json")).count() == 0


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["export", "-d", "x"])
    assert parser().parse_args(["translate", "-f", "x", "-l", "zh"]).source == "x"
