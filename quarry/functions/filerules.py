"""Which files of a repository are taken in: ordered rules on size, name, extension and folders, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
MAX_FILE_SIZE = 1048576
REJECTED_EXTENSIONS = tuple("""
.md .mdx .rst .txt .pdf .doc .docx .xls .xlsx .xlsm .xlsb .csv .tsv .ppt .pptx .odt .ods .odp .rtf
.png .jpg .jpeg .gif .bmp .svg .ico .webp .tiff .tif .psd .ai .eps
.woff .woff2 .ttf .otf .eot
.mp3 .mp4 .wav .avi .mov .mkv .flv .ogg .webm .m4a .m4v
.zip .tar .gz .bz2 .xz .7z .rar .tgz .tar.gz .jar .war .ear
.exe .dll .so .dylib .bin .dat .o .a .lib .class .pyc .pyo .wasm .deb .rpm .dmg .iso .img
.sql .sqlite .db .bak .dump .mdb
.pem .crt .key .cer .p12 .pfx
.map .min.js .min.css
.pen .fig .sketch
.log .lock .patch .diff
.yml .yaml .toml .ini .cfg .conf .properties .erb .ejs .hbs .mustache .jinja .jinja2
""".split())
REJECTED_DIRECTORIES = tuple("""
.*
.idea .vscode .cursor .vs .fleet .eclipse .settings .project
node_modules vendor bower_components jspm_packages .yarn .pnp
__pycache__ .venv venv env .env .tox .nox .mypy_cache .pytest_cache .ruff_cache *.egg-info
dist build out output target _build public static .next .nuxt .svelte-kit .parcel-cache .turbo
coverage .nyc_output htmlcov
tmp temp logs .cache .terraform .serverless
""".split())
REJECTED_FILENAMES = tuple("""
package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Pipfile.lock bun.lockb shrinkwrap.json npm-shrinkwrap.json go.sum Cargo.lock flake.lock
.DS_Store Thumbs.db .gitattributes .editorconfig .browserslistrc
LICENSE LICENSE.* LICENCE LICENCE.* COPYING COPYING.* NOTICE NOTICE.* THIRD_PARTY_NOTICES* AUTHORS AUTHORS.* CONTRIBUTORS CONTRIBUTORS.* PATENTS
README README.* CHANGELOG CHANGELOG.* CHANGES CHANGES.* HISTORY HISTORY.* RELEASE_NOTES*
Dockerfile Dockerfile.* docker-compose* Makefile Procfile .dockerignore .gitignore .npmignore .eslintignore .prettierignore
""".split())
# --- end of fixed values ---


@dataclass(frozen=True)
class Rules:
    """Rules of one repository; patterns are globs with ``*``, ``?`` and ``[...]``."""

    max_size: int = MAX_FILE_SIZE
    extensions: tuple[str, ...] = REJECTED_EXTENSIONS
    directories: tuple[str, ...] = REJECTED_DIRECTORIES
    filenames: tuple[str, ...] = REJECTED_FILENAMES


def glob_regex(pattern: str) -> str:
    """The pattern of a whole name for a glob; an unclosed bracket stands for itself."""
    piece = re.compile(r"(?P<set>\[!?\]?[^\]]*\])|(?P<any>[*?])|(?P<other>.)", re.DOTALL)

    def said(m: re.Match) -> str:
        if m["any"]:
            return ".*" if m["any"] == "*" else "."
        if m["set"]:
            negated, inner = m["set"][1] == "!", m["set"][1:-1].lstrip("!")
            return f"[{'^' if negated else ''}{re.sub(r'([\\^&\[\]])', r'\\\1', inner)}]"
        return re.escape(m["other"])

    return r"(?s)\A" + "".join(said(m) for m in piece.finditer(pattern)) + r"\z"


def first_glob(name: Column, patterns: tuple[str, ...]) -> Column:
    """Place, from 0, of the first pattern that fits a name, else null: a lookup for plain names, one regex a glob."""
    plain, globs = {}, []
    for place, p in enumerate(patterns):
        if re.search(r"[*?\[]", p):
            globs.append((place, p))
        else:
            plain.setdefault(p, place)
    found = [F.when(name.rlike(glob_regex(p)), F.lit(place)) for place, p in globs]
    if plain:
        known = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
        found.append(F.try_element_at(known, name))
    return F.array_min(F.array(*found)) if found else F.lit(None).cast("int")


def path_parts(path: Column) -> Column:
    """Parts of a path; empty ones and single dots are none."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def verdict(path: Column, size: Column, rules: Rules = Rules()) -> Column:
    """struct(reason, detail): the first rule that rejects a file, or ``none`` and an empty detail.

    In order: size above the limit; name, in lower case, fits a pattern; no extension; its extension is listed; a part of the
    path, the name included, fits a folder's pattern as it is written.  A null path is an empty one, a null size 0.
    """
    parts = path_parts(F.coalesce(path, F.lit("")))
    name = F.lower(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")))
    suffix = F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)
    listed = lambda values, place: F.get(F.array(*[F.lit(v) for v in values]), place)
    size = F.coalesce(size, F.lit(0))
    by_name = first_glob(name, tuple(p.lower() for p in rules.filenames))
    fits = F.transform(parts, lambda p, i: F.struct(first_glob(p, rules.directories).alias("place"), i.alias("i"), p.alias("part")))
    by_part = F.array_min(F.filter(fits, lambda x: x["place"].isNotNull()))

    def of(reason: str, *detail: Column | str) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.concat(*[F.lit(d) if isinstance(d, str) else d for d in detail]).alias("detail"))

    out = F.when(size > rules.max_size, of("size", "File size ", size.cast("string"), f" exceeds limit {rules.max_size}"))
    if rules.filenames:
        out = out.when(by_name.isNotNull(), of("extension", "Filename '", name, "' matches rejected pattern '", listed(rules.filenames, by_name), "'"))
    out = out.when(suffix == "", of("extension", "File '", name, "' has no extension"))
    out = out.when(suffix.isin(*[e.lower() for e in rules.extensions]), of("extension", "Extension ", suffix, " is rejected"))
    if rules.directories:
        out = out.when(by_part.isNotNull(), of("directory", "Directory '", by_part["part"], "' matches rejected pattern '", listed(rules.directories, by_part["place"]), "'"))
    return out.otherwise(of("none", ""))
