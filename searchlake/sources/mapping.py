"""Mappings: how documents become typed fields, and the walk that applies them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from searchlake.functions import dates, geo, numeric, vectors
from searchlake.functions.analysis import Analyzer, Registry

TYPES = ("text", "number", "datetime", "boolean", "geopoint", "geoshape", "IP", "vector", "vector_base64", "disabled")


@dataclass
class FieldMapping:
    type: str = "text"
    name: str | None = None
    analyzer: str | None = None
    index: bool = True
    store: bool = True
    doc_values: bool = True
    include_in_all: bool = True
    include_term_vectors: bool = True
    date_format: str | None = None
    dims: int = 0
    similarity: str = vectors.L2
    synonym_source: str | None = None

    @staticmethod
    def of(d: dict[str, Any]) -> FieldMapping:
        known = {"docvalues": "doc_values"}
        own = {known.get(k, k): v for k, v in d.items() if known.get(k, k) in FieldMapping.__dataclass_fields__ and v != ""}
        if d.get("type", "text") == "keyword":
            own |= {"type": "text", "analyzer": "keyword"}
        return FieldMapping(**own)


@dataclass
class DocumentMapping:
    enabled: bool = True
    dynamic: bool = True
    nested: bool = False
    properties: dict[str, DocumentMapping] = field(default_factory=dict)
    fields: list[FieldMapping] = field(default_factory=list)
    default_analyzer: str | None = None
    default_synonym_source: str | None = None

    @staticmethod
    def of(d: dict[str, Any]) -> DocumentMapping:
        own = {k: v for k, v in d.items() if k in ("enabled", "dynamic", "nested", "default_analyzer", "default_synonym_source") and v != ""}
        return DocumentMapping(**own, properties={k: DocumentMapping.of(v) for k, v in (d.get("properties") or {}).items()}, fields=[FieldMapping.of(f) for f in d.get("fields") or []])


@dataclass
class IndexMapping:
    types: dict[str, DocumentMapping] = field(default_factory=dict)
    default_mapping: DocumentMapping = field(default_factory=DocumentMapping)
    type_field: str = "_type"
    default_type: str = "_default"
    default_analyzer: str = "standard"
    default_datetime_parser: str = "dateTimeOptional"
    default_field: str = "_all"
    default_synonym_source: str | None = None
    index_dynamic: bool = True
    store_dynamic: bool = True
    docvalues_dynamic: bool = True
    scoring_model: str = "tfidf"
    analysis: dict[str, dict[str, Any]] = field(default_factory=dict)

    @staticmethod
    def of(d: dict[str, Any] | str) -> IndexMapping:
        if isinstance(d, str):
            d = json.loads(d)
        own = {k: v for k, v in d.items() if k in IndexMapping.__dataclass_fields__ and k not in ("types", "default_mapping") and v not in ("", None)}
        m = IndexMapping(**own, types={k: DocumentMapping.of(v) for k, v in (d.get("types") or {}).items()}, default_mapping=DocumentMapping.of(d.get("default_mapping") or {}))
        m.validate()
        return m

    def to_json(self) -> str:
        return json.dumps(self, default=lambda o: o.__dict__, sort_keys=True)

    def registry(self) -> Registry:
        own = Registry()
        for kind, plural in (("char_filter", "char_filters"), ("tokenizer", "tokenizers"), ("token_map", "token_maps"), ("token_filter", "token_filters"), ("analyzer", "analyzers")):
            waiting = dict(self.analysis.get(plural) or {})
            while waiting:  # components may name each other
                ready = []
                for name, config in waiting.items():
                    try:
                        own.add(kind, name, config)
                        ready.append(name)
                    except KeyError:
                        continue
                if not ready:
                    raise ValueError(f"unknown parts in {plural}: {sorted(waiting)}")
                for name in ready:
                    del waiting[name]
        return own

    def date_parser(self, name: str | None) -> dates.Parser:
        name = name or self.default_datetime_parser
        if name in dates.PARSERS:
            return dates.PARSERS[name]
        return dates.custom((self.analysis.get("date_time_parsers") or {})[name])

    def validate(self) -> None:
        own = self.registry()
        own.analyzer(self.default_analyzer)
        self.date_parser(None)

        def check(d: DocumentMapping, path: str) -> None:
            if d.default_analyzer:
                own.analyzer(d.default_analyzer)
            for f in d.fields:
                if f.type not in TYPES:
                    raise ValueError(f"unknown field type {f.type} at {path}")
                if f.analyzer and f.type == "text":
                    own.analyzer(f.analyzer)
                if f.type.startswith("vector") and not 1 <= f.dims <= 4096:
                    raise ValueError(f"vector dimensions at {path} must be 1 to 4096")
            for name, p in d.properties.items():
                check(p, f"{path}.{name}")

        for name, d in [*self.types.items(), ("_default", self.default_mapping)]:
            check(d, name)

    def document_mapping(self, doc: Any) -> DocumentMapping:
        kind = doc.get(self.type_field) if isinstance(doc, dict) else None
        return self.types.get(kind or self.default_type, self.default_mapping) if isinstance(kind or self.default_type, str) else self.default_mapping

    def analyzer_name(self, path: str) -> str:
        """The analyzer that queries on a path use: the field's own, else the nearest default."""
        for d in [*self.types.values(), self.default_mapping]:
            nearest, at, parts = d.default_analyzer, d, path.split(".")
            for i, part in enumerate(parts):
                # the last step may be a field with a name of its own
                for p in at.properties.values() if i == len(parts) - 1 else ():
                    for f in p.fields:
                        if f.name == part and f.analyzer and f.type == "text":
                            return f.analyzer
                if part not in at.properties:
                    break
                at = at.properties[part]
                nearest = at.default_analyzer or nearest
            else:
                for f in at.fields:
                    if f.type == "text" and f.analyzer and f.name in (None, parts[-1]):
                        return f.analyzer
            if nearest:
                return nearest
        return self.default_analyzer

    def synonym_collection(self, path: str) -> str | None:
        """The collection of synonyms that queries on a path use: that of the field's own source, else of the nearest default."""
        name, parts = self.default_synonym_source, path.split(".")
        for d in [*self.types.values(), self.default_mapping]:
            nearest, at = d.default_synonym_source, d
            for part in parts:
                if part not in at.properties:
                    break
                at = at.properties[part]
                nearest = at.default_synonym_source or nearest
            else:
                nearest = next((f.synonym_source for f in at.fields if f.synonym_source and f.name in (None, parts[-1])), nearest)
            if nearest:
                name = nearest
                break
        return None if name is None else ((self.analysis.get("synonym_sources") or {}).get(name) or {}).get("collection", name)

    def nested_paths(self) -> list[str]:
        def walk(d: DocumentMapping, path: str) -> Iterator[str]:
            for name, p in d.properties.items():
                here = f"{path}.{name}" if path else name
                if p.nested:
                    yield here
                yield from walk(p, here)

        return sorted({p for d in [*self.types.values(), self.default_mapping] for p in walk(d, "")})


#: one value of one field of one (possibly nested) document
ROW = "doc_id string, root_id string, ancestors array<string>, seq long, field string, ap array<long>, kind string, s string, d double, ts_ns long, b boolean, lon double, lat double, ip binary, vec array<float>, analyzer string, in_all boolean, indexed boolean, stored boolean, doc_values boolean"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


class Walker:
    """Turns JSON documents into field rows."""

    def __init__(self, mapping: IndexMapping):
        self.mapping = mapping

    def rows(self, doc_id: str, seq: int, doc: Any) -> list[tuple]:
        out: list[tuple] = []
        mapping = self.mapping.document_mapping(doc)
        if mapping.enabled:
            self._walk(out, (doc_id, doc_id, [doc_id], seq), doc, mapping, "", [], mapping.default_analyzer or self.mapping.default_analyzer)
        return out

    def _walk(self, out: list, who: tuple, value: Any, mapping: DocumentMapping | None, path: str, ap: list[int], analyzer: str, dynamic: bool = True) -> None:
        if value is None:
            return
        if mapping is not None:
            if not mapping.enabled:
                return
            analyzer, dynamic = mapping.default_analyzer or analyzer, dynamic and mapping.dynamic if path == "" else mapping.dynamic
        elif not dynamic:
            return
        if mapping is not None and mapping.fields and path:
            whole = [f for f in mapping.fields if f.type in ("geopoint", "geoshape", "vector", "vector_base64")]
            if whole and not (isinstance(value, list) and self._many(value, whole[0])):
                for f in whole:
                    self._field(out, who, value, f, path, ap, analyzer)
                if len(whole) == len(mapping.fields):
                    return
        if isinstance(value, dict):
            for name, own in value.items():
                inner = mapping.properties.get(name) if mapping is not None else None
                self._walk(out, who, own, inner, f"{path}.{name}" if path else name, ap, analyzer, dynamic)
        elif isinstance(value, list):
            for i, own in enumerate(value):
                if mapping is not None and mapping.nested and isinstance(own, dict):
                    child = f"{who[0]}_${path}_${i}"
                    inner_who = (child, who[1], [*who[2], child], who[3])
                    out.append(self._row(inner_who, "", [], "nested"))
                    for name, x in own.items():
                        self._walk(out, inner_who, x, mapping.properties.get(name), f"{path}.{name}", [*ap, i], analyzer, dynamic)
                else:
                    self._walk(out, who, own, mapping, path, [*ap, i], analyzer, dynamic)
        elif mapping is not None and mapping.fields:
            for f in mapping.fields:
                if f.type not in ("geopoint", "geoshape", "vector", "vector_base64"):
                    self._field(out, who, value, f, path, ap, analyzer)
        elif dynamic:
            self._dynamic(out, who, value, path, ap, analyzer)

    @staticmethod
    def _many(value: list, f: FieldMapping) -> bool:
        """Whether a list holds several values of a field rather than being one."""
        if f.type == "geopoint":
            return bool(value) and not isinstance(value[0], (int, float))
        if f.type == "vector":
            return bool(value) and isinstance(value[0], list)
        return True

    def _dynamic(self, out: list, who: tuple, value: Any, path: str, ap: list[int], analyzer: str) -> None:
        m = self.mapping
        f = FieldMapping(index=m.index_dynamic, store=m.store_dynamic, doc_values=m.docvalues_dynamic)
        if isinstance(value, bool):
            f.type = "boolean"
        elif isinstance(value, (int, float)):
            f.type = "number"
        elif self.mapping.date_parser(None)(value) is not None:
            f.type = "datetime"
        self._field(out, who, value, f, path, ap, analyzer)

    def _row(self, who: tuple, path: str, ap: list[int], kind: str, f: FieldMapping | None = None, **values: Any) -> tuple:
        f = f or FieldMapping(index=False, store=False, doc_values=False, include_in_all=False)
        own = dict(zip(("doc_id", "root_id", "ancestors", "seq"), who, strict=True)) | {"field": path, "ap": ap, "kind": kind, "in_all": f.include_in_all, "indexed": f.index, "stored": f.store, "doc_values": f.doc_values} | values
        return tuple(own.get(c) for c in _COLUMNS)

    def _field(self, out: list, who: tuple, value: Any, f: FieldMapping, path: str, ap: list[int], analyzer: str) -> None:
        if f.type == "disabled":
            return
        if f.name:
            path = ".".join([*path.split(".")[:-1], f.name])
        kind, values = f.type, {}
        if kind == "text":
            if not isinstance(value, str):
                return
            values = {"s": value, "analyzer": f.analyzer or analyzer}
        elif kind == "number":
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                return
            values = {"d": float(value)}
        elif kind == "datetime":
            ns = self.mapping.date_parser(f.date_format)(str(value)) if not isinstance(value, bool) else None
            if ns is None or not -(1 << 63) <= ns < 1 << 63:
                return
            values = {"ts_ns": ns, "s": str(value)}
        elif kind == "boolean":
            if not isinstance(value, bool):
                return
            values = {"b": value}
        elif kind == "geopoint":
            point = geo.parse_point(value)
            if point is None:
                return
            values = {"lon": point[0], "lat": point[1]}
        elif kind == "geoshape":
            if not isinstance(value, dict):
                return
            values = {"s": json.dumps(value)}
        elif kind == "IP":
            own = numeric.ip_bytes(value) if isinstance(value, str) else None
            if own is None:
                return
            values = {"ip": own, "s": value}
        else:
            vec = vectors.decode_base64(value) if kind == "vector_base64" else value
            if len(vec) != f.dims or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in vec):
                return
            kind, values = "vector", {"vec": [float(x) for x in vec], "s": f.similarity}
        out.append(self._row(who, path, ap, kind, f, **values))


def analyzers(mapping: IndexMapping) -> dict[str, Analyzer]:
    """Every analyzer that fields of the mapping may name."""
    own = mapping.registry()
    names = {mapping.default_analyzer}

    def walk(d: DocumentMapping) -> None:
        names.update({d.default_analyzer} - {None})
        names.update(f.analyzer for f in d.fields if f.type == "text" and f.analyzer)
        for p in d.properties.values():
            walk(p)

    for d in [*mapping.types.values(), mapping.default_mapping]:
        walk(d)
    return {n: own.analyzer(n) for n in names}
