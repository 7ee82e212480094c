"""Chat formatting by schema fingerprints.

A record's layout is known by a hash of its nested field paths. The hash selects a
declarative mapping, which says where turns, roles and texts are; all records become
rows ``conv_id, turn, role, text``. Tables are mapped once by their schema, JSON
records one by one. The template marks turns; control strings inside texts are escaped
so that reading back gives the texts as they were.

Conversations are written in parts of whole turns and bounded length, by tasks that
stream over sorted rows: a conversation of any size needs the memory of one part.

Defined results: null text and null role count as empty; turns order by number (null
first), then role and text; repeated rows are turns of their own; a null conversation
is one like any other; an empty table gives an empty one; further columns are ignored.
Records of an unknown layout come back from ``unmapped``, not as turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>\n"
PART_CHARS = 1 << 18

# Where each layout keeps its turns: ("list", path, role key, text key) or ("fields", (role, field) ...).
LAYOUTS = {
    "prompt": (("prompt", "completion"), (), ("fields", ("user", "prompt"), ("assistant", "completion"))),
    "response": (("prompt", "response"), ("system",), ("fields", ("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "instruction": (("instruction", "output"), ("input", "system"), ("fields", ("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    "question": (("question", "answer"), (), ("fields", ("user", "question"), ("assistant", "answer"))),
    "messages": (("messages[].role", "messages[].content"), (), ("list", "messages", "role", "content")),
    "conversations": (("conversations[].from", "conversations[].value"), (), ("list", "conversations", "from", "value")),
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN_ROWS = ("conv_id", "role", "text", "turn")


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _mappings() -> dict[str, tuple[str, tuple]]:
    """A mapping for every layout with any of its optional fields."""
    out = {}
    for name, (needed, optional, rule) in LAYOUTS.items():
        for n in range(len(optional) + 1):
            for extra in combinations(optional, n):
                out[fingerprint((*needed, *extra))] = (name, rule)
    return out


MAPPINGS = _mappings()
KNOWN_PATHS = {p for needed, optional, _ in LAYOUTS.values() for p in (*needed, *optional)}


def json_paths(value, prefix: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from json_paths(inner, f"{prefix}.{key}" if prefix else key)
    elif isinstance(value, list):
        for inner in value:
            yield from json_paths(inner, f"{prefix}[]")
    else:
        yield prefix


def schema_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for field in kind:
            yield from schema_paths(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{prefix}[]")
    else:
        yield prefix


def map_record(record) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and turns of one record; fields that no layout knows do not count."""
    if not isinstance(record, dict):
        return None, []
    name, rule = MAPPINGS.get(fingerprint(p for p in json_paths(record) if p in KNOWN_PATHS), (None, ()))
    if name is None:
        return None, []
    if rule[0] == "list":
        _, path, role, text = rule
        return name, [(ROLES.get(m.get(role), m.get(role)) or "", _text(m.get(text))) for m in record[path]]
    turns = []
    for role, *fields in rule[1:]:
        texts = [_text(record[f]) for f in fields if record.get(f) not in (None, "")]
        if texts or role != "system":
            turns.append((role, "\n\n".join(texts)))
    return name, turns


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


_TURNS = "conv_id long, turn long, role string, text string"


def turns_from_json(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of JSON records of any known layout."""
    return _mapped(records, conv_id, record, _TURNS, lambda conv, raw: [(conv, i, r, t) for i, (r, t) in enumerate(_load(raw)[1])])


def unmapped(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """The records without a known layout, with the fingerprint to add one for."""

    def rows(conv, raw):
        name, _ = _load(raw)
        return [] if name else [(conv, _print_of(raw), raw)]

    return _mapped(records, conv_id, record, "conv_id long, fingerprint string, record string", rows)


def _parse(raw):
    try:
        return json.loads(raw) if raw is not None else None
    except ValueError:
        return None


def _load(raw):
    return map_record(_parse(raw))


def _print_of(raw) -> str:
    return fingerprint(json_paths(_parse(raw)))


def _mapped(records: DataFrame, conv_id: str, record: str, schema: str, rows) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    names = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(names)

    def run(batches):
        for batch in batches:
            out = [row for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in rows(conv, raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

    return records.select(F.col(conv_id).cast("long"), F.col(record).cast("string")).mapInArrow(run, schema)


def turns_from_rows(table: DataFrame) -> DataFrame:
    """Canonical turns of a table with one row per turn, known by its schema."""
    paths = [p for p in schema_paths(table.schema) if p in TURN_ROWS]
    if fingerprint(paths) != fingerprint(TURN_ROWS):
        raise ValueError(f"no mapping for the fields {sorted(set(schema_paths(table.schema)))}")
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def _sorted(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_starts, loss_ends``: the loss mask in code points of the part."""

    def run(batches):
        conv, part, pieces, size, starts, ends = None, 0, [], 0, [], []
        fresh = True

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array(["".join(pieces)], pa.string()),
                 pa.array([starts], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64()))],
                names=["conv_id", "part", "formatted", "loss_starts", "loss_ends"])

        for batch in batches:
            for own, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if fresh or own != conv or size >= PART_CHARS:
                    if not fresh:
                        yield flush()
                    part = part + 1 if not fresh and own == conv else 0
                    conv, pieces, size, starts, ends, fresh = own, [], 0, [], [], False
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                if role == "assistant":
                    starts.append(size + len(head))
                    ends.append(size + len(head) + len(body))
                pieces += (head, body, END)
                size += len(head) + len(body) + len(END)
        if not fresh:
            yield flush()

    return _sorted(turns, "turn", "role", "text").mapInArrow(
        run, "conv_id long, part long, formatted string, loss_starts array<long>, loss_ends array<long>")


def parse_part(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of one part; escaped texts hold no control string, so markers are unambiguous."""
    for piece in formatted.split(END)[:-1]:
        head, _, body = piece.removeprefix(START).partition("\n")
        yield unescape_role(head), unescape(body)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: turn and loss counts and digests."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, fresh, n, chars, total, turns, loss = None, True, 0, 0, 0, None, None

        def row():
            values = (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for own, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
                if fresh or own != conv:
                    if not fresh:
                        yield row()
                    conv, fresh, n, chars, total, turns, loss = own, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                total += len(text)
                for role, said in parse_part(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    masked = unescape(text[a:b])
                    chars += len(masked)
                    loss.update(masked.encode())
        if not fresh:
            yield row()

    return _sorted(formatted, "part").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
