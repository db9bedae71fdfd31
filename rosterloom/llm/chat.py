"""Chat formatting: records of many layouts to canonical turns, and turns to marked text.

A record's layout is the set of its nested field paths (`messages[].role`, ...) that any mapping
names; other fields, like an id or a source, don't count. The hash of that set, its fingerprint,
picks a declarative mapping, which says where the turns are and which role each has. Fields that are
null count only if the record has no layout without them; a required field that is null is an empty
turn. A record whose fingerprint belongs to no mapping has no turns and is reported as such.

The template marks each turn with control strings and escapes all known control strings inside
texts by `\\.` after their first character and backslashes by doubling; both are taken back when the
formatted text is read. The loss mask covers the assistant texts, as spans in the formatted text.

A null text is empty, a null role is the empty role. A table with a row a turn is formatted row by
row, without a shuffle; reading it back goes through the rows in order of (conversation, turn) and
keeps only running sums, so a conversation of any length takes constant memory. Its rows do go to
one task, as a digest of a whole text can only be made from its beginning to its end. Rows with
equal (conversation, turn) are put in order of role and text; a null conversation is one of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer some chat template; none of them is left whole inside a text.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_SPECIAL = re.compile(r"\\|\n|" + "|".join(map(re.escape, CONTROL)))
_PLAIN = re.compile(r"\\(.)")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """Where a kind of record has its turns.

    `turns` are (role, path) pairs in order: a fixed role for a plain path; for a path into a list,
    the name of the field beside it that holds the role. `required` fields mark the layout,
    `optional` ones may be absent.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    roles: Mapping[str, str] = field(default_factory=dict)

    def fingerprints(self) -> list[str]:
        parts = chain.from_iterable(combinations(self.optional, n)
                                    for n in range(len(self.optional) + 1))
        return [fingerprint({*self.required, *some}) for some in parts]


_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant",
          "model": "assistant"}
LAYOUTS = (
    Layout("turn", (("@role", "text"),), ("text",), ("role",), _NAMES),
    Layout("turns", (("@turns[].role", "turns[].text"),), ("turns[].role", "turns[].text")),
    Layout("messages", (("system", "system"), ("@messages[].role", "messages[].content")),
           ("messages[].role", "messages[].content"), ("system",), _NAMES),
    Layout("conversations", (("system", "system"), ("@conversations[].from", "conversations[].value")),
           ("conversations[].from", "conversations[].value"), ("system",), _NAMES),
    Layout("prompt", (("system", "system"), ("user", "prompt"), ("assistant", "completion")),
           ("prompt", "completion"), ("system",)),
    Layout("response", (("system", "system"), ("user", "prompt"), ("assistant", "response")),
           ("prompt", "response"), ("system",)),
    Layout("question", (("system", "system"), ("user", "question"), ("assistant", "answer")),
           ("question", "answer"), ("system",)),
    Layout("instruction", (("system", "system"), ("user", "instruction+input"),
                           ("assistant", "output")), ("instruction", "output"), ("system", "input")),
)
#: A table's row that is one turn: either field may be null, roles are kept as they are.
TURN_ROW = (Layout("turn row", (("@role", "text"),), (), ("role", "text")),)


def paths(value: object, at: str = "", nulls: bool = False) -> set[str]:
    """The paths of all fields that hold something (or, with `nulls`, of all); list elements share one."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k, nulls) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]", nulls) for v in value))
    return {at} if nulls or value is not None else set()


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=12).hexdigest()


class Registry(dict[str, Layout]):
    """Layouts by fingerprint, and the paths that any of them names."""

    def __init__(self, layouts: tuple[Layout, ...]):
        super().__init__((key, layout) for layout in layouts for key in layout.fingerprints())
        self.known = {p for layout in layouts for p in (*layout.required, *layout.optional)}

    def of(self, record: dict) -> Layout | None:
        own = self.get(fingerprint(paths(record) & self.known))
        return own or self.get(fingerprint(paths(record, nulls=True) & self.known))


def _registry(layouts: tuple[Layout, ...]) -> Registry:
    return Registry(layouts)


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def canonical(record: object, registry: Registry) -> tuple[str | None, list[tuple[str, str]]]:
    """The record's layout (None: unknown) and its turns as (role, text)."""
    layout = registry.of(record) if isinstance(record, dict) else None
    if layout is None:
        return None, []
    out = []
    for role, path in layout.turns:
        if role.startswith("@") and "[]." in path:
            outer, text = path.split("[].")
            name = role.split("[].")[1]
            for item in record[outer]:
                if not isinstance(item, dict):
                    continue
                own = _text(item.get(name))
                out.append((layout.roles.get(own, own), _text(item.get(text))))
        elif role.startswith("@"):
            own = _text(record.get(role[1:]))
            out.append((layout.roles.get(own, own), _text(record.get(path))))
        else:
            some = [_text(record[p]) for p in path.split("+") if record.get(p) is not None]
            if some or layout.required and path.split("+")[0] in layout.required:
                out.append((role, "\n\n".join(s for s in some if s)))
    return layout.name, out


def escape(text: str, line_breaks: bool = False) -> str:
    def one(m: re.Match) -> str:
        s = m.group()
        if s == "\n":
            return "\\n" if line_breaks else s
        return "\\\\" if s == "\\" else s[0] + "\\." + s[1:]

    return _SPECIAL.sub(one, text)


def unescape(text: str) -> str:
    kinds = {"\\": "\\", ".": "", "n": "\n"}
    return _PLAIN.sub(lambda m: kinds[m.group(1)], text)


def formatted_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """One turn as marked text, and the span in it that counts for the loss."""
    head = f"{START}{escape(role, True)}\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else None
    return f"{head}{body}{END}\n", span


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, id_col: str, json_col: str,
                   layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, formatted, loss) of each row's JSON record; layout null: unknown or no JSON.

    `loss` holds the spans (start, end) of the assistant texts in `formatted`.
    """
    def formatted(batches: Iterator[pa.RecordBatch]):
        registry = _registry(layouts)
        for batch in slices(batches, "record"):
            names, texts, spans = [], [], []
            for raw in batch.column("record").to_pylist():
                try:
                    record = json.loads(raw) if raw else None
                except ValueError:
                    record = None
                name, turns = canonical(record, registry)
                parts, loss, at = [], [], 0
                for role, text in turns:
                    part, span = formatted_turn(role, text)
                    if span:
                        loss.append({"start": at + span[0], "end": at + span[1]})
                    parts.append(part)
                    at += len(part)
                names.append(name)
                texts.append("".join(parts))
                spans.append(loss)
            yield pa.record_batch({
                "_id": batch.column("_id"), "layout": pa.array(names, pa.string()),
                "formatted": pa.array(texts, pa.string()),
                "loss": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()),
                                                            ("end", pa.int32())])))})

    rows = records.select(F.col(id_col).alias("_id"), F.col(json_col).alias("record"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        formatted, f"_id {kind}, layout string, formatted string, "
                   "loss array<struct<start:int,end:int>>").withColumnRenamed("_id", id_col)


def format_turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, turn, formatted, loss): the marked text of each row of a table of turns.

    A conversation's formatted text is its rows' texts in order of turn, end to end.
    """
    record = F.to_json(F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    rows = turns.select(F.struct(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"))
                        .alias("key"), record.alias("record"))
    return format_records(rows, "key", "record", TURN_ROW).select(
        F.col("key.conv").alias(conv_col), F.col("key.turn").alias(turn_col), "layout",
        "formatted", "loss")


class _Digest:
    """Running sums over the turns of one conversation."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))


def _digests(batches: Iterator[pa.RecordBatch]):
    current, digest, out = None, None, []

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                               names=names)

    def closed() -> tuple:
        return (current, digest.turns, digest.all.hexdigest(), digest.loss_chars,
                digest.loss.hexdigest(), digest.chars)

    for batch in slices(batches, "formatted"):
        for conv, text, spans in zip(batch.column("conv_id").to_pylist(),
                                     batch.column("formatted").to_pylist(),
                                     batch.column("loss").to_pylist()):
            if digest is None or conv != current:
                if digest is not None:
                    out.append(closed())
                current, digest = conv, _Digest()
            digest.add(text, spans)
        if out:
            yield batch_of(out)
            out = []
    if digest is not None:
        yield batch_of([closed()])


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Digests of the turns and of the loss text, read from the rows of `format_turn_rows`."""
    rows = formatted.select(F.col(conv_col).cast("bigint").alias("conv_id"),
                            F.col(turn_col).alias("turn"), "formatted", "loss")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, "
                                        "loss_chars bigint, loss_sha256 string, formatted_chars bigint")
