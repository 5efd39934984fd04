"""Durable JSON artifacts: read, checked, and written."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import InvalidArtifactError

VERSION = 1
EQUIVALENCES, SYNONYMS, RELATIONSHIPS, STATS, FREQUENCY, VOCABULARY = (f"search-v2-{x}" for x in ("equivalences", "synonyms", "relationships", "corpus-stats", "lexical-frequency", "vocabulary"))
_UNSAFE = frozenset(("__proto__", "prototype", "constructor"))


def checked(artifact: object, kind: str) -> dict | None:
    """The artifact if it is of that format and version; None stays None, all else raises."""
    if artifact is None:
        return None
    if not isinstance(artifact, Mapping):
        raise InvalidArtifactError("an artifact must be an object", kind)
    if artifact.get("format") != kind:
        raise InvalidArtifactError(f"expected format {kind}, found {artifact.get('format')!r}", "format")
    if artifact.get("version") != VERSION:
        raise InvalidArtifactError(f"expected version {VERSION}, found {artifact.get('version')!r}", "version")
    return dict(artifact)


def load(path: str | Path, kind: str) -> dict | None:
    return checked(json.loads(Path(path).read_text()), kind)


def save(artifact: Mapping, path: str | Path) -> None:
    """JSON with sorted keys, so equal artifacts are equal bytes."""
    Path(path).write_text(canonical(artifact) + "\n")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha256(value: object) -> str:
    return hashlib.sha256((value if isinstance(value, str) else canonical(value)).encode()).hexdigest()


def strength(value: object) -> float:
    """A strength within [0, 1]; 1 where missing, 0 where not a finite number."""
    if value is None:
        return 1.0
    try:
        x = float(value)
    except (TypeError, ValueError):
        return 0.0
    return min(1.0, max(0.0, x)) if math.isfinite(x) else 0.0


def equivalences(artifact: object) -> list[dict]:
    """Dictionary entries of an equivalences artifact, from its list or its map by key."""
    found = checked(artifact, EQUIVALENCES)
    if not found:
        return []
    entries = found.get("entries", found.get("equivalences", []))
    if isinstance(entries, Mapping):
        entries = [{"key": k, **(v if isinstance(v, Mapping) else {"expansion": v})} for k, v in entries.items() if k not in _UNSAFE]
    if not isinstance(entries, list):
        raise InvalidArtifactError("entries must be a list or an object", "entries")
    return [dict(e) for e in entries if isinstance(e, Mapping) and e.get("key") and e["key"] not in _UNSAFE]


def synonyms(artifact: object) -> list[dict]:
    found = checked(artifact, SYNONYMS)
    entries = (found or {}).get("entries", [])
    if not isinstance(entries, list):
        raise InvalidArtifactError("entries must be a list", "entries")
    return [{**e, "terms": [str(t).lower() for t in e["terms"]]} for e in entries if isinstance(e, Mapping) and isinstance(e.get("terms"), list) and len(e["terms"]) >= 2]


def relationships(spark: SparkSession, artifact: object) -> DataFrame:
    """(source, ord, target, type, strength, provenance) of a relationships artifact; the order of edges counts."""
    found = checked(artifact, RELATIONSHIPS) or {}
    rows = []
    for source, edges in (found.get("relationships") or {}).items():
        if source in _UNSAFE or not isinstance(edges, list):
            continue
        for i, e in enumerate(e for e in edges if isinstance(e, Mapping) and e.get("target")):
            rows.append((str(source), i, str(e["target"]), str(e.get("type") or "related"), strength(e.get("strength")), e.get("provenance")))
    return spark.createDataFrame(rows, "source string, ord int, target string, type string, strength double, provenance string")


def relationships_artifact(edges: DataFrame) -> dict:
    """An artifact of a graph; edges in each list strongest first, then by type and target.

    The artifact is one JSON file by its format, so its size is what a reader can hold; larger graphs stay tables.
    """
    lists = edges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("o"), "type", "target", "strength", "provenance"))).alias("e"))
    out: dict[str, list] = {}
    for r in lists.orderBy("source").toLocalIterator():
        out[r["source"]] = [{k: x[k] for k in ("target", "type", "strength", "provenance") if x[k] is not None} for x in r["e"]]
    return {"format": RELATIONSHIPS, "version": VERSION, "relationships": out}


def frequency_artifact(counts: DataFrame, policy: Mapping[str, int]) -> dict:
    """An artifact of n-gram counts (id, gram, n) by document."""
    maps = counts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gram", "n"))).alias("g"))
    return {"format": FREQUENCY, "version": VERSION, "policy": dict(policy), "documents": {r["id"]: {"ngrams": {x["gram"]: x["n"] for x in r["g"]}} for r in maps.orderBy("id").toLocalIterator()}}


def corpus_documents(spark: SparkSession, path: str, keep_metadata: bool = False) -> DataFrame:
    """(id, title, body[, metadata]) of a JSON file: a list of documents or an object that has one; ordered by id.

    The id falls back to the title, the body to content; documents with neither id nor title are left out.
    """
    metadata = "map<string,string>"
    doc = f"id string, title string, body string, content string, metadata {metadata}"
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_struct(doc)}>>")
    held = F.from_json("value", f"struct<documents:array<struct<{_struct(doc)}>>>")["documents"]
    is_list = F.startswith(F.ltrim(F.col("value")), F.lit("["))
    rows = whole.select(F.explode(F.when(is_list, listed).otherwise(held)).alias("d")).select("d.*")
    out = rows.select(F.coalesce(F.nullif(F.trim("id"), F.lit("")), "title").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.nullif("body", F.lit("")), "content", F.lit("")).alias("body"), *(["metadata"] if keep_metadata else []))
    return out.where("id is not null").orderBy("id")


def _struct(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (c.strip().split(" ", 1) for c in ddl.split(", ")))
