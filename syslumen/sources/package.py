"""Product document packages: directories or zip archives (also nested) with a profile, a navigation tree and HTML pages.

An archive is read where it lies, an entry at a time; the table of packages is a table of binary files, so
that packages are dealt out over tasks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.session import by_value

by_value(__name__)

# Limits on archives, depth of nesting and of the tree, words of severity.
ENTRIES, RATIO, FILE_BYTES, TOTAL_BYTES, NESTED_DEPTH, NESTED_COUNT, NESTED_BYTES = 200_000, 1000, 2 << 30, 20 << 30, 2, 8, 256 << 20
TREE_DEPTH, TREE_BYTES = 16, 64 << 20
#: Pages that are parsed before their fields are handed on.
PAGES = 64
SEVERITY_WORDS = {"紧急": 1, "critical": 1, "重要": 2, "major": 2, "次要": 3, "minor": 3, "警告": 4, "warning": 4, "提示": 6, "info": 6}


class PackageError(ValueError):
    """An archive that is too large, too deep or leads out of itself."""


def decode(raw: bytes) -> str:
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


def entries(raw: bytes, depth: int = 0) -> Iterator[tuple[str, zipfile.ZipFile, zipfile.ZipInfo]]:
    """Files of an archive and of those within it; paths have forward slashes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > ENTRIES or sum(i.file_size for i in infos) > TOTAL_BYTES:
            raise PackageError("too many entries or bytes")
        nested = 0
        for info in infos:
            path = posixpath.normpath(info.filename.replace("\\", "/"))
            if path.startswith(("/", "../")) or path == ".." or info.file_size > FILE_BYTES or info.file_size > RATIO * max(info.compress_size, 1) + (1 << 20):
                raise PackageError(f"{info.filename}: leads out of the archive or is too large")
            if info.is_dir():
                continue
            if path.lower().endswith((".hdx", ".zip")) and depth < NESTED_DEPTH and nested < NESTED_COUNT and info.file_size <= NESTED_BYTES:
                nested += 1
                yield from ((f"{path}/{p}", zz, i) for p, zz, i in entries(z.read(info), depth + 1))
            else:
                yield path, z, info


def profile(text: str) -> dict[str, str]:
    root = ElementTree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text.strip()))
    found = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in root.iter()}
    return {out: found.get(tag, "") for tag, out in (("libId", "lib_id"), ("libName", "name"), ("libVersion", "version"), ("productType", "product_type"), ("productVersion", "product_version"), ("language", "language"))}


def leaves(text: str) -> list[dict]:
    """Leaf topics that are logs (``Module/Severity/Brief``) or alarms below a module's topic."""
    if len(text) > TREE_BYTES:
        raise PackageError("navigation tree is too large")
    root = ElementTree.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text.strip()))
    out: list[dict] = []

    def walk(e: ElementTree.Element, chain: tuple[str, ...]) -> None:
        own = [c for c in e if c.tag.rsplit("}", 1)[-1] == "topic"]
        name = e.get("txt", "").strip()
        if own and len(chain) < TREE_DEPTH:
            for c in own:
                walk(c, (*chain, name) if name else chain)
        elif not own and e.get("url"):
            m = re.fullmatch(r"([\w\-]+)/([0-8])/([\w\- ]+)", name)
            above = next((re.sub(r"(日志|告警)$", "", c).strip() for c in reversed(chain) if c.endswith(("日志", "告警"))), "")
            base = {"topic_id": e.get("id", ""), "txt": name, "url": e.get("url"), "chain": list(chain)}
            if m:
                out.append({**base, "entry_type": "LOG", "module": m[1].upper(), "severity": int(m[2]), "brief": m[3]})
            elif any(c.endswith("告警") for c in chain) and name:
                out.append({**base, "entry_type": "ALARM", "module": above.upper(), "severity": 4, "brief": name.split()[-1]})

    walk(root, ())
    return out


def resolve(base: str, url: str) -> str:
    """A link's path within a package, empty if it leads out."""
    path = posixpath.normpath(posixpath.join(base, unquote(re.split(r"[?#]", url)[0]).replace("\\", "/").lstrip("/")))
    return "" if path.startswith("..") else path


class _Sections(HTMLParser):
    """Text by heading; block elements end lines, scripts and styles are left out."""

    _BLOCKS = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.sections, self.rows = "", {}, []
        self._heading, self._skip, self._in, self._text, self._cells = "", 0, "", [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self._skip += 1
        if tag in ("title", "h1", "h2", "h3", "h4"):
            self._flush()
            self._in = tag
        elif tag in self._BLOCKS:
            self._text.append("\n")
        if tag == "tr":
            self._cells = []
        if tag in ("td", "th") and self._cells is not None:
            self._cells.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        if tag == self._in:
            own = clean("".join(self._text))
            self._text, self._in = [], ""
            if tag == "title":
                self.title = own
            else:
                self._heading = own
                self.title = self.title or own
        if tag == "tr" and self._cells:
            self.rows.append([clean(c) for c in self._cells])
            self._cells = None

    def handle_data(self, data: str) -> None:
        if not self._skip:
            self._text.append(data)
            if self._cells:
                self._cells[-1] += data

    def _flush(self) -> None:
        own = clean_lines("".join(self._text))
        if own:
            self.sections[self._heading] = f"{self.sections[self._heading]}\n{own}" if self._heading in self.sections else own
        self._text = []

    def close(self) -> None:
        super().close()
        self._flush()


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()


def clean_lines(text: str) -> str:
    return "\n".join(x for x in map(clean, text.split("\n")) if x)


# Headings of a page's sections, by what they hold.
_HEADINGS = {"message": ("日志信息", "告警信息", "message", "log message"), "description": ("日志含义", "告警解释", "meaning", "description"), "impact": ("对系统的影响", "impact"), "cause": ("可能原因", "possible causes", "cause"), "action": ("处理步骤", "procedure", "action")}


def page(html: str) -> dict[str, str]:
    """A page's title, text and the sections that knowledge is made of."""
    p = _Sections()
    p.feed(html)
    p.close()
    out = {"title": p.title, "text": clean_lines("\n".join(p.sections.values()))}
    for field, names in _HEADINGS.items():
        out[field] = next((v for k, v in p.sections.items() if k.lower() in names), "")
    out["parameters"] = "; ".join(f"{r[0]}={r[1]}" for r in p.rows if len(r) == 2 and r[0] not in ("参数名称", "Parameter", ""))
    word = next((r[1] for r in p.rows if len(r) >= 2 and r[0] in ("告警级别", "Severity")), "")
    out["severity"] = str(SEVERITY_WORDS.get(word.lower(), ""))
    return out


_PAGE = "title string, text string, message string, description string, impact string, cause string, action string, parameters string, severity string"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key`` and the fields of ``html``, ``PAGES`` rows at a time, whatever comes in a batch."""
    fields = [f.split()[0] for f in _PAGE.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            part = batch.slice(at, PAGES)
            made = [page(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array([m[f] for m in made], pa.string()) for f in fields)], ["key", *fields])


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The fields of HTML pages; a null page has empty ones."""
    own = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return own.mapInArrow(parsed, f"key {own.schema['key'].dataType.simpleString()}, {_PAGE}").withColumnRenamed("key", key)


_LEAF = "package string, lib_id string, product_type string, product_version string, entry_type string, topic_id string, module string, severity int, brief string, url string, chain array<string>, message string, description string, impact string, cause string, action string, parameters string"


def _rows(package: str, files: dict[str, bytes]) -> list[dict]:
    by_name = {k.lower(): k for k in files}
    out = []
    for own in [k for k in files if posixpath.basename(k).lower() == "profile.xml"]:
        base, about = posixpath.dirname(own), profile(decode(files[own]))
        tree = by_name.get(posixpath.join(base, "resources/navi.xml").lower())
        for leaf in leaves(decode(files[tree])) if tree else []:
            at = by_name.get(resolve(posixpath.join(base, "resources"), leaf["url"]).lower())
            told = page(decode(files[at])) if at else page("")
            out.append({"package": package, **{k: about[k] for k in ("lib_id", "product_type", "product_version")}, **{k: leaf[k] for k in ("entry_type", "topic_id", "module", "severity", "brief", "url", "chain")}, **{k: told[k] for k in ("message", "description", "impact", "cause", "action", "parameters")}})
    return out


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each leaf topic of each archive; archives that can't be read fail the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{hdx,zip}").load(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found = {p: z.read(i) for p, z, i in entries(bytes(content)) if p.lower().endswith((".xml", ".html", ".htm"))}
                yield pd.DataFrame(_rows(path.rsplit("/", 1)[-1], found), columns=[f.split()[0] for f in re.sub(r"<[^>]*>", "", _LEAF).split(", ")])

    return files.select("path", "content").mapInPandas(run, _LEAF)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The same for a package that lies unpacked in a directory: its files are grouped, as links lead from one to another."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(xml|html?)$"))
    root = path.rstrip("/")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {p.split(root, 1)[-1].lstrip("/"): bytes(c) for p, c in zip(pdf["path"], pdf["content"], strict=True)}
        return pd.DataFrame(_rows(root.rsplit("/", 1)[-1], found), columns=[f.split()[0] for f in re.sub(r"<[^>]*>", "", _LEAF).split(", ")])

    return files.select("path", "content").groupBy(F.lit(root).alias("g")).applyInPandas(run, _LEAF)


def knowledge_of(leaves_: DataFrame) -> DataFrame:
    """Entries of leaf topics with their content hash, each once."""
    from syslumen.functions.scalar import content_hash

    fields = ("entry_type", "module", "severity", "brief", "message", "description", "parameters", "impact", "cause", "action")
    return leaves_.select(*fields, "lib_id", "product_type", "product_version", "topic_id").withColumn("content_hash", content_hash(*(F.col(f) for f in fields)))
