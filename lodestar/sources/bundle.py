"""Knowledge bundles: folders of markdown concepts with front matter, read and written.

Reading is distributed: files are listed and parsed in Arrow batches by workers.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Files that aren't concepts.
RESERVED = ("index.md", "log.md")
DEEPEST = 200
LINK = r"\]\(([^()\s#]+?\.md)(?:#[^()\s]*)?\)"
CONCEPT = "concept_id string, path string, type string, title string, description string, resource string, tags array<string>, status string, stale_after string, body string, links array<string>, extra string"
_FIELDS = [c.split()[0] for c in CONCEPT.split(", ")]
_OWN = {"type", "title", "description", "resource", "tags", "status", "stale_after"}


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def _tags(value: Any) -> list[str]:
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else value if isinstance(value, (list, tuple)) else [value]
    return [t for t in (str(p).strip() for p in parts) if t]


def parse_concept(path: str, text: str) -> dict[str, Any] | None:
    """The concept in a file, path relative to the bundle; None where the front matter is absent, broken or has no type."""
    import yaml

    if not text.startswith("---"):
        return None
    end = text.find("\n---", 3)
    if end < 0:
        return None
    try:
        front = yaml.safe_load(text[3:end])
    except (yaml.YAMLError, RecursionError, ValueError):
        return None
    if not isinstance(front, dict) or not front.get("type"):
        return None
    rest = text[end + 4 :]
    body = rest.split("\n", 1)[1].strip() if "\n" in rest else ""
    extra = {str(k): _text(v) if isinstance(v, (datetime.date, datetime.datetime)) else v for k, v in front.items() if k not in _OWN and (v is None or isinstance(v, (str, int, float, bool, datetime.date, datetime.datetime)))}
    return {
        "concept_id": path[:-3] if path.endswith(".md") else path,
        "path": path,
        "type": _text(front["type"]),
        "title": _text(front.get("title")),
        "description": _text(front.get("description")),
        "resource": _text(front.get("resource")),
        "tags": _tags(front.get("tags")),
        "status": _text(front.get("status")) or "stable",
        "stale_after": _text(front.get("stale_after")),
        "body": body,
        "links": re.findall(LINK, body),
        "extra": json.dumps(extra, ensure_ascii=False),
    }


def concept_files(root: str) -> list[str]:
    """Paths of the concepts' files below root, relative to it; links that lead out of it are passed over."""
    base = Path(root).resolve()
    found = []
    for path in sorted(Path(root).rglob("*.md")):
        if path.name not in RESERVED and path.is_file() and path.resolve().is_relative_to(base):
            found.append(path.relative_to(root).as_posix())
    return found


def read_bundle(spark: SparkSession, root: str, *, malformed: bool = False) -> DataFrame:
    """The concepts of a bundle (CONCEPT); with malformed, files that hold none too, as rows with a null type.

    A file that can't be decoded holds no concept.
    """
    ship(spark)
    base = str(Path(root).resolve())
    paths = spark.createDataFrame([(p,) for p in concept_files(root)], "path string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    made = parse_concept(path, (Path(base) / path).read_bytes().decode())
                except (OSError, UnicodeDecodeError):
                    made = None
                rows.append(made or {"concept_id": path[:-3], "path": path})
            kinds = {"tags": pa.list_(pa.string()), "links": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], kinds.get(f, pa.string())) for f in _FIELDS], names=_FIELDS)

    parsed = paths.repartition(min(64, spark.sparkContext.defaultParallelism)).mapInArrow(parse, CONCEPT)
    return parsed if malformed else parsed.where("type IS NOT NULL")


def link_target(link: str, folder: str) -> str:
    """The id of the concept that a link in a file of that folder leads to."""
    path = link.lstrip("/") if link.startswith("/") else posixpath.normpath(posixpath.join(folder, link))
    return path[:-3] if path.endswith(".md") else path


def concept_edges(concepts: DataFrame, *, skip_external: bool = False) -> DataFrame:
    """Edges "references" (source_id, target_id, relation, metadata) of the links in concepts, as often as they stand there."""
    target = F.udf(lambda link, path: link_target(link, posixpath.dirname(path)), "string", useArrow=True)
    links = concepts.select(F.col("concept_id").alias("source_id"), "path", F.explode("links").alias("link"))
    if skip_external:
        links = links.where(~F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    return links.select("source_id", target("link", "path").alias("target_id"), F.lit("references").alias("relation"), F.lit("{}").alias("metadata"))


def concept_records(concepts: DataFrame, *, prefix: str = "extra_") -> DataFrame:
    """(id, text, metadata) of concepts: text is title, description and body; scalars of extra get the prefix."""
    text = F.concat_ws("\n\n", F.when(F.col("title") != "", F.col("title")), F.when(F.col("description") != "", F.col("description")), F.col("body"))

    @F.udf("string", useArrow=True)
    def metadata(type_, title, description, resource, tags, status, stale_after, path, links, extra):
        own = {"type": type_, "title": title, "description": description, "resource": resource, "tags": list(tags or []), "status": status, "stale_after": stale_after, "path": path, "links": list(links or [])}
        return json.dumps(own | {prefix + k: v for k, v in json.loads(extra or "{}").items()}, separators=(",", ":"), ensure_ascii=False)

    return concepts.select(F.col("concept_id").alias("id"), text.alias("text"), metadata("type", "title", "description", "resource", "tags", "status", "stale_after", "path", "links", "extra").alias("metadata"))


@dataclass
class ConceptInput:
    """A document to be written as a concept; what is None is derived from its text."""

    text: str
    id: str | None = None
    title: str | None = None
    type: str = "Document"
    description: str | None = None
    tags: list[str] = field(default_factory=list)
    resource: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)


_HEADING = re.compile(r"^#{1,6}[ \t]+(\S.*?)[ \t]*#*$", re.M)
LONGEST_TITLE, LONGEST_DESCRIPTION = 80, 200


def slug(text: str) -> str:
    """Letters and digits of ASCII in lower case, anything else a hyphen."""
    return "-".join(re.findall(r"[a-z0-9]+", text.lower())) or "concept"


def title_from_name(name: str) -> str:
    return " ".join(part.capitalize() for part in re.findall(r"[^-_]+", posixpath.basename(name)))


def derive_title(text: str, fallback: str) -> tuple[str, str]:
    """(title, the text after it): a heading at the top or a first line that isn't a sentence, else the fallback."""
    rest = text.strip()
    first, _, after = rest.partition("\n")
    if heading := _HEADING.fullmatch(first.strip()):
        return heading[1], after
    first = first.strip()
    if first and len(first) <= LONGEST_TITLE and first[-1] not in ".!?:;" and not re.search(r"[.!?]\s", first):
        return first, after
    return fallback, rest


def derive_description(text: str) -> str:
    """The beginning of a text without headings, up to LONGEST_DESCRIPTION: to a sentence's end if it holds one, else to a word's."""
    flat = " ".join(_HEADING.sub("", text).split())
    if len(flat) <= LONGEST_DESCRIPTION:
        return flat
    head = flat[:LONGEST_DESCRIPTION]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", head)]
    return head[: ends[-1]] if ends else head.rpartition(" ")[0].rstrip() + "…"


def safe_id(id_: str) -> str:
    """The id, if it is a relative path that stays where it is put; else ValueError."""
    parts = id_.split("/")
    if not id_ or id_.startswith(("/", "~", "\\")) or "\\" in id_ or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"unsafe concept id {id_!r}")
    return id_


def render_concept(concept: ConceptInput, producer: str, at: datetime.datetime) -> str:
    """The markdown of a concept: front matter and text."""
    import yaml

    front = {"type": concept.type, "title": concept.title, "description": concept.description, "tags": concept.tags or None, "resource": concept.resource} | concept.extra
    front = {k: v for k, v in front.items() if v not in (None, "")} | {"generated": {"at": at.isoformat(timespec="seconds"), "by": producer}}
    return f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True).rstrip()}\n---\n\n{concept.text.strip()}\n"


def _inputs(source, extensions: tuple[str, ...], default_type: str) -> Iterator[ConceptInput]:
    if isinstance(source, DataFrame):
        names = {"text", "id", "title", "type", "description", "tags", "resource"} & set(source.columns)
        for row in source.select(*names).toLocalIterator():
            yield ConceptInput(**({"type": default_type} | {k: v for k, v in row.asDict().items() if v is not None}))
        return
    if isinstance(source, (str, Path)):
        root = Path(source)
        for path in sorted(p for p in root.rglob("*") if p.is_file() and p.suffix in extensions):
            name = path.relative_to(root).with_suffix("").as_posix()
            yield ConceptInput(path.read_text(errors="replace"), id=name, type=default_type)
        return
    for item in source:
        if isinstance(item, Mapping):
            yield ConceptInput(**({"type": default_type} | dict(item)))
        elif isinstance(item, ConceptInput):
            yield item
        else:
            raise TypeError(f"no document: {item!r}")


def write_bundle(source: str | Path | DataFrame | Iterable, out: str, *, default_type: str = "Document", producer: str = "lodestar", extensions: tuple[str, ...] = (".txt", ".md"), at: datetime.datetime | None = None) -> list[dict[str, str]]:
    """Writes documents (a folder, a DataFrame, mappings or ConceptInputs) as a bundle; a row (id, title, description, path) for each.

    Ids that collide get -2, -3 and so on, in order; so this goes document by
    document, on the driver.  An index.md stands in each folder, log.md in the first.
    """
    at = at or datetime.datetime.now(datetime.UTC)
    root = Path(out).resolve()
    root.mkdir(parents=True, exist_ok=True)
    taken: set[str] = {name[:-3] for name in RESERVED}
    rows = []
    for concept in _inputs(source, extensions, default_type):
        title, rest = derive_title(concept.text, title_from_name(concept.id or "concept"))
        if concept.title is None:
            concept.title = title
        if concept.description is None:
            concept.description = derive_description(rest)
        wanted = safe_id(concept.id if concept.id is not None else slug(concept.title))
        id_, n = wanted, 1
        while id_ in taken or posixpath.basename(id_) + ".md" in RESERVED:
            n += 1
            id_ = f"{wanted}-{n}"
        taken.add(id_)
        path = (root / f"{id_}.md").resolve()
        if not path.is_relative_to(root):
            raise ValueError(f"{id_!r} leads out of the bundle")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(render_concept(concept, producer, at))
        rows.append({"id": id_, "title": concept.title, "description": concept.description or "", "path": str(path)})
    _write_indexes(root, rows)
    plural = "" if len(rows) == 1 else "s"
    (root / "log.md").write_text(f"---\ntype: Log\ntitle: Bundle history\n---\n\n# {at.date().isoformat()}\n\n- {producer} wrote {len(rows)} concept{plural}.\n")
    return rows


def _write_indexes(root: Path, rows: list[dict[str, str]]) -> None:
    folders: dict[str, list[dict[str, str]]] = {"": []}
    for row in rows:
        folder = posixpath.dirname(row["id"])
        folders.setdefault(folder, []).append(row)
        while folder:
            folder = posixpath.dirname(folder)
            folders.setdefault(folder, [])
    for folder, own in folders.items():
        blocks = []
        if own:
            entries = sorted(own, key=lambda r: r["title"].lower())
            blocks.append("# Concepts\n\n" + "\n".join(f"* [{r['title']}]({posixpath.basename(r['id'])}.md)" + (f" - {r['description']}" if r["description"] else "") for r in entries))
        below = sorted(posixpath.basename(f) for f in folders if f and posixpath.dirname(f) == folder)
        if below:
            blocks.append("# Subdirectories\n\n" + "\n".join(f"* [{f}]({f}/index.md)" for f in below))
        (root / folder / "index.md").write_text("\n\n".join(blocks) + "\n")
