"""Chat formatting by schema fingerprints.

Records come as JSON in whatever layout their source has: lists of messages, prompt and response, instruction with input and
output. A record's schema fingerprint is a hash of its nested field paths with their kinds (list items share a path, nulls
have no kind). The fingerprint selects a declarative mapping: either where the list of turns is and what its role and text
are called, or an ordered list of fields with the roles that they speak. Mappings are written for paths, and fingerprints
of all the layouts that a mapping allows are made from it; a record that no mapping knows is reported, not guessed.

Canonical turns are (role, text). A mapping names what roles are called in its layout's dialect (human, gpt); these become user
and assistant, others stay, and layouts without a dialect keep every role as it is. The template writes a turn as ``### Role: text</turn>`` and a line feed. Inside texts and roles, backslash, ``#`` and ``</`` are
escaped (in roles also ``:``), so neither mark can stand in them, and formatted text reads back exactly. The loss mask is the
list of spans of assistant texts in the formatted text, as code points.

Null texts and roles are empty. A record without turns formats as the empty text. Repeated records give a row each, an empty
table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """``turns``: path of a list whose items have ``role`` and ``text``; or ``fields``: (path, role) in order, optional ones marked by a ?.

    ``roles``: pairs of a role's name in the dialect and the canonical one."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def layouts(self) -> Iterator[frozenset[str]]:
        """Every set of field paths that a record of this layout can have."""
        if self.turns:
            item = [(), (f"{self.turns}[].{self.role}:string",)], [(), (f"{self.turns}[].{self.text}:string",)]
            yield frozenset([f"{self.turns}:list"])
            for a, b in product(*item):
                yield frozenset([f"{self.turns}:list", f"{self.turns}[]:object", *a, *b])
        else:
            choices = [((f"{p.removesuffix('?')}:string",), ()) if p.endswith("?") else ((f"{p}:string",),) for p, _ in self.fields]
            for chosen in product(*choices):
                yield frozenset(x for part in chosen for x in part)


#: Fixed layouts of conversation records, and fixed names that their dialects have for roles.
DIALECT = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("sharegpt", turns="conversations", role="from", text="value", roles=DIALECT),
    Mapping("dialog", turns="dialog.turns", role="speaker", text="utterance", roles=DIALECT),
    Mapping("prompt", fields=(("system?", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("completion", fields=(("system?", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction", fields=(("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    Mapping("task", fields=(("instruction", "user"), ("output", "assistant"))),
)

OPEN, CLOSE = "### ", "</turn>\n"


def field_paths(value, path: str = "") -> set[str]:
    """Paths of a record's fields with their kinds."""
    if isinstance(value, dict):
        found = {f"{path}:object"} if path else set()
        for key, inner in value.items():
            found |= field_paths(inner, f"{path}.{key}" if path else key)
        return found - {p for p in found if p == f"{path}:object" and not path.endswith("[]")}
    if isinstance(value, list):
        return {f"{path}:list"}.union(*(field_paths(x, f"{path}[]") for x in value))
    if value is None:
        return set()
    return {f"{path}:{'string' if isinstance(value, str) else 'bool' if isinstance(value, bool) else 'number'}"}


def schema_fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def known_schemas(mappings=MAPPINGS) -> dict[str, Mapping]:
    known: dict[str, Mapping] = {}
    for mapping in mappings:
        for layout in mapping.layouts():
            known.setdefault(schema_fingerprint(layout), mapping)
    return known


def canonical_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    def at(path: str):
        value = record
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value

    if mapping.turns:
        rows = [(x.get(mapping.role) or "", x.get(mapping.text) or "") for x in at(mapping.turns) or []]
        return [(dict(mapping.roles).get(role, role), text) for role, text in rows]
    return [(role, at(path.removesuffix("?")) or "") for path, role in mapping.fields if at(path.removesuffix("?")) is not None]


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the spans of it that are trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace(":", "\\:") + ": "
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\:]|\\.)*): ", re.DOTALL)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text, as they were."""
    turns, at = [], 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        end = formatted.find(CLOSE, at)
        if not head or end < head.end():
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return turns


def loss_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def format_records(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """conv_id, schema, mapping, formatted, spans (list of start and end) from rows (conv_id, record as JSON).

    A record whose schema no mapping knows has a null mapping, formatted text and spans; so has a null or broken record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_schemas(mappings)
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                schema = schema_fingerprint(field_paths(record)) if isinstance(record, dict) else None
                mapping = known.get(schema)
                if mapping is None:
                    rows.append((schema, None, None, None))
                    continue
                formatted, spans = format_turns(canonical_turns(record, mapping))
                rows.append((schema, mapping.name, formatted, spans))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "schema", "mapping", "formatted", "spans"])

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(run, "conv_id long, schema string, mapping string, formatted string, spans array<array<long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted text and spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is None:
                    rows.append((None,) * 5)
                    continue
                turns = parse_turns(text)
                loss = loss_text(text, spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_records(turns: DataFrame) -> DataFrame:
    """conv_id and one JSON record a conversation, from rows (conv_id, turn, role, text).

    Turns stand by turn, then role, then text. Conversations of a user and an assistant turn are written as prompts or as
    tasks, those of a system, a user and an assistant turn as instructions, the others as one of the two lists of messages; conv_id
    decides between the two, but one with a role that is a dialect's name for another is written as messages, which keep
    every role. A null conv_id is a conversation; repeated rows are turns each. A record is one value, so a conversation
    has to fit into a task's memory."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.select(F.col("conv_id").cast("long"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.replace(x["role"], F.lit(","), F.lit(" "))), ",")
    text = lambda k: F.get("t", F.lit(k))["text"]
    listed = lambda role, content: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(content)))
    even = F.coalesce(F.col("conv_id"), F.lit(0)) % 2 == 0
    json_ = lambda *fields: F.to_json(F.struct(*fields))
    record = (
        F.when((said == "user,assistant") & even, json_(text(0).alias("prompt"), text(1).alias("response")))
        .when(said == "user,assistant", json_(text(0).alias("instruction"), text(1).alias("output")))
        .when(said == "system,user,assistant", json_(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output")))
        .when(even | F.exists("t", lambda x: x["role"].isin([name for name, _ in DIALECT])), json_(listed("role", "content").alias("messages")))
        .otherwise(json_(listed("from", "value").alias("conversations")))
    )
    return whole.select("conv_id", record.alias("record"))
