"""Document conversion by an external program: arguments are planned here, the program runs only if it is there."""

from __future__ import annotations

import posixpath
import shutil
import subprocess
from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class ExportOptions:
    format: str = "docx"
    template: str = ""
    toc: bool = False
    toc_depth: int = 3
    shift: int = 0
    file_as_title: bool = False
    site_type: str = "basic"
    nav_path: str = ""


def arguments(source: str, output: str, cwd: str, options: ExportOptions, source_dirs: Iterable[str] = ()) -> list[str]:
    """Arguments in fixed order, resource paths ascending."""
    # fixed values
    args = [source, "-o", output, "--standalone", "--pdf-engine=xelatex", "-V", "mainfont=SimSun", "--wrap=preserve", "--embed-resources"]
    folders = {posixpath.dirname(source) or ".", cwd, posixpath.dirname(output) or ".", *source_dirs}
    for d in sorted(folders):
        args += ["--resource-path", d]
    if options.template:
        args += ["--reference-doc", options.template]
    if options.toc:
        args += ["--toc"]
        if options.toc_depth > 0:
            args += ["--toc-depth", str(options.toc_depth)]
    if options.shift:
        args += ["--shift-heading-level-by", str(options.shift)]
    if options.format == "pdf":
        args += ["-V", "CJKmainfont=SimSun", "-V", "documentclass=article", "-V", "geometry=margin=1in"]
    elif options.format == "epub":
        args += ["--epub-chapter-level=1"]
    return args


def available(program: str = "pandoc") -> bool:
    return shutil.which(program) is not None


def convert(args: list[str], cwd: str, program: str = "pandoc") -> None:
    if not available(program):
        raise FileNotFoundError(f"{program} is not installed")
    subprocess.run([program, *args], cwd=cwd, check=True, capture_output=True)
