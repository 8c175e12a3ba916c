"""Instance documents read event by event: namespaces, both kinds of quotes, comments, CDATA, character references, any encoding.

A document becomes one row of contexts, units and facts; what they mean is decided by column expressions afterwards. Memory is
one document. Nothing outside it is ever read: documents with a DTD or entity declaration are refused before they are parsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.functions.fixed_values import DIMENSION_NAMESPACE, INSTANCE_NAMESPACE

CONTEXT = "struct<name:string,start:string,end:string,instant:string,has_period:boolean,sliced:boolean>"
FACT = "struct<namespace:string,concept:string,context:string,unit:string,decimals:string,text:string,amount:string>"
UNIT = "struct<name:string,measure:string>"
READ = f"problem string, contexts array<{CONTEXT}>, units array<{UNIT}>, facts array<{FACT}>"

FORBIDDEN, INCOMPLETE = "DTD or entity declarations are not permitted", "not a complete instance document"


def amount_of(text: str) -> str | None:
    """One spelling for equal decimals of any scale; none for what is no finite decimal."""
    try:
        sign, digits, exponent = Decimal(text.replace(",", "")).as_tuple()
    except InvalidOperation:
        return None
    if not isinstance(exponent, int):
        return None
    spelled = "".join(map(str, digits)).lstrip("0")
    short = spelled.rstrip("0")
    return f"{'-' if sign else ''}{short}e{exponent + len(spelled) - len(short)}" if short else "0"


class Instance:
    """What one document tells: `feed` takes its bytes once."""

    def __init__(self):
        self.contexts, self.units, self.facts = [], [], []
        self.path: list[tuple[str, str]] = []
        self.open = self.text = None

    def feed(self, content: bytes) -> str | None:
        lowered = content.lower()
        if b"<!doctype" in lowered or b"<!entity" in lowered:
            return FORBIDDEN
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.StartElementHandler, parser.EndElementHandler = self.start, self.end
        parser.CharacterDataHandler = self.characters
        parser.buffer_text = True
        try:
            parser.Parse(content, True)
        except (expat.ExpatError, ValueError, LookupError):
            return INCOMPLETE
        return None if self.root == (INSTANCE_NAMESPACE, "xbrl") else INCOMPLETE

    def start(self, name: str, attributes: dict[str, str]) -> None:
        space, _, local = name.rpartition(" ")
        self.path.append((space, local))
        self.text = None  # an element's text ends where its first child begins
        place, own = len(self.path), space == INSTANCE_NAMESPACE
        if place == 1:
            self.root = (space, local)
        elif place == 2:
            self.open = None
            if own and local == "context":
                self.open = {"name": attributes.get("id", "").strip(), "start": None, "end": None, "instant": None, "has_period": False, "sliced": False}
                self.contexts.append(self.open)
            elif own and local == "unit":
                self.open = {"name": attributes.get("id", "").strip(), "measure": None}
                self.units.append(self.open)
            elif "contextRef" in attributes:
                self.open = {"namespace": space, "concept": local, "context": attributes["contextRef"], "unit": attributes.get("unitRef") or None,
                             "decimals": attributes.get("decimals", ""), "text": "", "amount": None}
                self.facts.append(self.open)
                self.text = []
        elif self.open is not None and "sliced" in self.open:
            if place == 3 and own and local == "period":
                self.open["has_period"] = True
            self.open["sliced"] |= space == DIMENSION_NAMESPACE and local in ("explicitMember", "typedMember")
            if place == 4 and own and self.path[2] == (INSTANCE_NAMESPACE, "period"):
                self.text = []
        elif self.open is not None and "measure" in self.open and own and local == "measure":
            self.text = []

    def characters(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def end(self, _: str) -> None:
        (_, local), place = self.path.pop(), len(self.path) + 1
        if self.text is None and not (place == 2 and self.open is not None and "concept" in self.open):
            return
        told = "".join(self.text or ()).strip()
        if place == 2:
            if self.text is not None:
                self.open["text"] = told
            self.open["amount"] = amount_of(self.open["text"])
        elif "measure" in self.open:
            self.open["measure"] = told if self.open["measure"] is None else f"{self.open['measure']} / {told}"
        elif local in ("startDate", "endDate", "instant"):
            self.open[{"startDate": "start", "endDate": "end", "instant": "instant"}[local]] = told
        self.text = None


def read_instances(files: DataFrame) -> DataFrame:
    """Replace `content` by what the document holds; `problem` says why one cannot be read."""
    kept = [c for c in files.columns if c != "content"]
    types = dict(files.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), READ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(batch.schema.get_field_index("content"))):
                one = Instance()
                problem = one.feed(content.as_py() or b"")
                made = {"problem": problem, "contexts": [] if problem else one.contexts, "units": [] if problem else one.units,
                        "facts": [] if problem else one.facts}
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *(pa.array([made[n]], kind) for n, kind in _KINDS.items())], names=[*kept, *_KINDS])

    return files.select(*kept, "content").mapInArrow(run, schema)


def _strings(*names: str, flags: tuple[str, ...] = ()) -> pa.DataType:
    return pa.list_(pa.struct([*((n, pa.string()) for n in names), *((n, pa.bool_()) for n in flags)]))


_KINDS = {
    "problem": pa.string(), "contexts": _strings("name", "start", "end", "instant", flags=("has_period", "sliced")),
    "units": _strings("name", "measure"), "facts": _strings("namespace", "concept", "context", "unit", "decimals", "text", "amount")}
