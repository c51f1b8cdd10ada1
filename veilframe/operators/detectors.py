"""Personal-data detectors as pluggable functions from text to (kind, value) pairs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import python

Detector = Callable[[str], Iterable[tuple[str, str]]]
CHUNK, OVERLAP, GLINER_THRESHOLD = 900, 150, 0.3
# A zero-shot model's labels and the kinds they stand for.
GLINER_LABELS = {"person": "PERSON", "address": "ADDRESS", "date of birth": "DOB", "phone number": "PHONE", "email": "EMAIL", "insurance number": "INSURANCE"}
_FENCE, _CAPITALISED = python(fixed.FENCE), python(fixed.CAPITALISED_WORD)


def windows(text: str, size: int = CHUNK, overlap: int = OVERLAP, empty_is_chunk: bool = False) -> Iterator[str]:
    """Overlapping windows; the last one is the first that reaches the end."""
    at = 0
    while at < len(text) or empty_is_chunk and at == 0:
        yield text[at : at + size]
        if at + size >= len(text):
            return
        at += size - overlap


def plausible(kind: str, value: str) -> bool:
    """Not empty; a person is no role word and holds a capitalised word."""
    kind, value = kind.strip().upper(), value.strip()
    if not (kind and value):
        return False
    return kind != "PERSON" or value.lower() not in fixed.NOT_PERSONS and bool(_CAPITALISED.search(value))


def reply_entities(reply) -> list[tuple[str, str]]:
    """Entities of a model's reply: JSON text (fenced or not), an object that lists them, a list, or a single one."""
    if isinstance(reply, str):
        fenced = _FENCE.search(reply)
        reply = json.loads(fenced[1] if fenced else reply)
    if isinstance(reply, dict):
        listed = reply.get("entities")
        reply = listed if isinstance(listed, list) else [reply] if reply.get("kind") and reply.get("value") else None
    if not isinstance(reply, list):
        raise ValueError("the detector's reply lists no entities")
    pairs = ((str(x.get("kind") or ""), str(x.get("value") or "")) for x in reply if isinstance(x, dict))
    return [(k.strip(), v.strip()) for k, v in pairs if plausible(k, v)]


def chunked(ask: Callable[[str], object], size: int = CHUNK, overlap: int = OVERLAP) -> Detector:
    """A detector that asks a model chunk by chunk; ask takes a chunk and returns its reply."""

    def detect(text: str) -> list[tuple[str, str]]:
        found = (entity for part in windows(text, size, overlap) for entity in reply_entities(ask(part)))
        return list(dict.fromkeys(found))

    return detect


# The kinds that a prompted model may name.
PROMPTED_KINDS = ["PERSON", "ADDRESS", "DOB", "INSURANCE", "EMAIL", "PHONE"]
PROMPT = "List every piece of personal data in the text, exactly as written, as JSON: an object with entities, a list of objects with kind and value. Kinds: " + ", ".join(PROMPTED_KINDS) + "."


def reply_schema() -> dict:
    """The JSON schema that a prompted model's reply must follow."""
    entity = {"type": "object", "properties": {"kind": {"type": "string", "enum": PROMPTED_KINDS}, "value": {"type": "string"}}, "required": ["kind", "value"]}
    return {"type": "object", "properties": {"entities": {"type": "array", "items": entity}}, "required": ["entities"]}


def prompted(fetch: Callable[[dict], object], model: str, size: int = CHUNK, overlap: int = OVERLAP) -> Detector:
    """A detector over a model that follows a schema: fetch takes a request and returns the reply's content. Temperature 0, a request a chunk."""
    if not model:
        raise ValueError("a prompted detector needs a model")
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunks need 0 <= overlap < size")
    body = {"model": model, "stream": False, "format": reply_schema(), "options": {"temperature": 0}}
    return chunked(lambda part: fetch(body | {"messages": [{"role": "system", "content": PROMPT}, {"role": "user", "content": part}]}), size, overlap)


def configured(options, *, fetch: Callable[[dict], object] | None = None, predict=None) -> Detector | None:
    """The detector that a ``config.Detection`` asks for: none, one or the union of several. What a named model needs must be injected."""
    found = []
    if options.zero_shot_model:
        if predict is None:
            raise RuntimeError("a zero-shot model is configured, but nothing to run it")
        found.append(zero_shot(predict, size=options.chunk_size, overlap=options.chunk_overlap))
    if options.prompted_model:
        if fetch is None:
            raise RuntimeError("a prompted model is configured, but nothing to ask it")
        found.append(prompted(fetch, options.prompted_model, options.chunk_size, options.chunk_overlap))
    return union(*found)


def zero_shot(predict: Callable[[str, list[str], float], Iterable[dict]], threshold: float = GLINER_THRESHOLD, size: int = CHUNK, overlap: int = OVERLAP) -> Detector:
    """A detector over a span model: predict takes text, labels and threshold and returns dicts with label and text."""

    def detect(text: str) -> list[tuple[str, str]]:
        spans = (s for part in windows(text, size, overlap, empty_is_chunk=True) for s in predict(part, list(GLINER_LABELS), threshold))
        return list(dict.fromkeys((GLINER_LABELS[s["label"].lower()], s["text"]) for s in spans if s["label"].lower() in GLINER_LABELS))

    return detect


def union(*detectors: Detector) -> Detector | None:
    """None without detectors, the one itself, or all of them: first seen stays, by kind in upper case and trimmed value."""
    if len(detectors) < 2:
        return detectors[0] if detectors else None

    def detect(text: str) -> list[tuple[str, str]]:
        seen: dict[tuple[str, str], tuple[str, str]] = {}
        for detector in detectors:
            for kind, value in detector(text):
                seen.setdefault((kind.strip().upper(), value.strip()), (kind, value))
        return list(seen.values())

    return detect


def probe(detector: Detector) -> None:
    """Fail before a job starts if the detector cannot answer."""
    try:
        list(detector("probe"))
    except Exception as error:
        raise RuntimeError("the detector does not answer") from error


def pattern_detector(kind: str, pattern: str, flags: int = 0) -> Detector:
    compiled = re.compile(pattern, flags)
    return lambda text: [(kind, m[0]) for m in compiled.finditer(text)]


def reply_column(reply: Column) -> Column:
    """Entities of replies as a column: the three JSON shapes; null where it is none of them."""
    entity = "struct<kind:string,value:string>"
    body = F.trim(F.when(reply.rlike(f"(?is){fixed.FENCE[0]}"), F.regexp_extract(reply, f"(?is){fixed.FENCE[0]}", 1)).otherwise(reply))
    listed = F.from_json(body, f"struct<entities:array<{entity}>>")["entities"]
    one = F.from_json(body, entity)
    single = F.when(one["kind"].isNotNull() & one["value"].isNotNull(), F.array(one))
    return F.when(body.startswith("["), F.from_json(body, f"array<{entity}>")).otherwise(F.coalesce(listed, single))


def detect(documents: DataFrame, detector: Detector) -> DataFrame:
    """documents with entities, array of (kind, value), a batch at a time."""
    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "value": v} for k, v in detector(t or "")])

    return documents.withColumn("entities", run("text"))
