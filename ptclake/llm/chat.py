"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns, which a reversible template writes out.

A layout's fingerprint is the hash of its sorted nested field paths. ``MAPPINGS`` ties fingerprints to declarative mappings; records of
an unknown layout are an error for a table and null for JSON records, never guessed. Fields beside those of a known layout are ignored:
paths are tried whole, then without those that no layout names, then those of each layout that are all there, the longest first.

Template of one turn: ``<s>ROLE[INST] text [/INST]</s>``. Inside roles and texts, each control string gets a backslash behind its
first character and each backslash is doubled, so a text can't open or close anything, and reading undoes it exactly.
The loss mask is the escaped text of assistant turns, as spans of code points in a turn's segment.

Edge cases: null texts and roles are empty; turns go by number, then role and text (a null number first); repeated rows are
turns each; rows with a null conversation id form one conversation; an empty table gives no row; further columns are
left out. One conversation is read as a stream, so its length isn't bound by memory. In JSON records, texts and roles that are no
strings stand as their JSON text, list elements that are no objects are turns without a role, numbers of conversations and turns
that aren't 64-bit integers are null, and lone surrogates become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED = re.compile("|".join([re.escape("\\"), *map(re.escape, CONTROL)]))
_UNESCAPED = re.compile(r"\\\\|(?<=[<\[])\\")
_SEGMENT = re.compile(r"<s>(.*?)\[INST\] (.*) \[/INST\]</s>\Z", re.S)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; ``[]`` marks an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def json_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; an empty list or object counts as one field."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in json_paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in json_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "replace")).hexdigest()[:16]


#: Layouts by their field paths: how to get turns (role, text) from a record; ``rows`` are tables with a row for each turn.
LAYOUTS = {
    "rows": (("conv_id", "turn", "role", "text"), {"conv": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    "messages": (("messages[].role", "messages[].content"), {"each": "messages", "role": "role", "text": "content"}),
    "conversations": (("conversations[].from", "conversations[].value"), {"each": "conversations", "role": "from", "text": "value"}),
    "prompt": (("prompt", "response"), {"turns": (("user", "prompt"), ("assistant", "response"))}),
    "prompt_completion": (("prompt", "completion"), {"turns": (("user", "prompt"), ("assistant", "completion"))}),
    "instruction": (("instruction", "output"), {"turns": (("user", "instruction"), ("assistant", "output"))}),
    "instruction_input": (("instruction", "input", "output"), {"turns": (("user", "instruction", "input"), ("assistant", "output"))}),
    "question": (("question", "answer"), {"turns": (("user", "question"), ("assistant", "answer"))}),
}
MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS.values()}
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _canonical_role(role: Column) -> Column:
    for k, v in ROLES.items():
        role = F.when(role == k, v).otherwise(role)
    return F.coalesce(role, F.lit(""))


_NAMED = {p for ps, _ in LAYOUTS.values() for p in ps}


def mapping_of(paths) -> tuple[str, dict] | None:
    """The fingerprint and mapping for a record's field paths."""
    paths = set(paths)
    tries = [paths, paths & _NAMED, *sorted((ps for ps, _ in LAYOUTS.values() if set(ps) <= paths), key=len, reverse=True)]
    return next(((mark, MAPPINGS[mark]) for t in tries if (mark := fingerprint(t)) in MAPPINGS), None)


def canonical_turns(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """A table of any known layout to ``conv_id, turn, role, text``."""
    found = mapping_of(field_paths(records.schema))
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(records.schema))}")
    mapping = found[1]
    if "conv" in mapping:
        turns = records.select(F.col(mapping["conv"]).alias("conv_id"), F.col(mapping["turn"]).alias("turn"), F.col(mapping["role"]).alias("role"), F.col(mapping["text"]).alias("text"))
    elif "each" in mapping:
        turns = records.select(F.col(key).alias("conv_id"), F.posexplode(mapping["each"]).alias("turn", "t")).select("conv_id", "turn", F.col("t")[mapping["role"]].alias("role"), F.col("t")[mapping["text"]].alias("text"))
    else:
        text = lambda f: F.col(f).cast("string")
        made = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(text(f) != "", text(f)) for f in fields]).alias("text")) for role, *fields in mapping["turns"]]
        turns = records.select(F.col(key).alias("conv_id"), F.posexplode(F.array(*made)).alias("turn", "t")).select("conv_id", "turn", "t.*")
    return turns.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.col("turn").try_cast("long").alias("turn"), _canonical_role(F.col("role").cast("string")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_SURROGATE = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return _SURROGATE.sub("\ufffd", text)


def _integer(value) -> int | None:
    whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return int(value) if whole and -(2**63) <= value < 2**63 else None


def record_turns(key: int | None, record, mapping: dict) -> list[tuple[int | None, int | None, str, str]]:
    """Conversation, turn, role and text of a record's turns by its mapping."""
    if "conv" in mapping:
        conv, turn, role, text = (record.get(mapping[k]) for k in ("conv", "turn", "role", "text"))
        rows = [(_integer(conv), _integer(turn), _text(role), _text(text))]
    elif "each" in mapping:
        turns = [t if isinstance(t, dict) else {mapping["text"]: t} for t in record[mapping["each"]]]
        rows = [(key, i, _text(t.get(mapping["role"])), _text(t.get(mapping["text"]))) for i, t in enumerate(turns)]
    else:
        rows = [(key, i, role, "\n".join(filter(None, (_text(record.get(f)) for f in fields)))) for i, (role, *fields) in enumerate(mapping["turns"])]
    return [(k, i, ROLES.get(role, role), text) for k, i, role, text in rows]


def json_turns(records: DataFrame, key: str, payload: str) -> DataFrame:
    """JSON records of mixed layouts, a record in column ``payload``: ``conv_id, layout, turn, role, text``.

    Each record's fingerprint chooses its mapping; what is no record of a known layout is one row with null turn, role and text.
    """

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[frozenset, tuple[str, dict] | None] = {}
        for f in frames:
            out = []
            for k, raw in zip(f["k"], f["payload"], strict=True):
                k = None if pd.isna(k) else int(k)
                try:
                    record = json.loads(raw)
                    paths = frozenset(json_paths(record)) if isinstance(record, dict) else frozenset()
                except (TypeError, ValueError, RecursionError):
                    record, paths = None, frozenset()
                if paths not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[paths] = mapping_of(paths) if paths else None
                if known[paths] is None:
                    out.append((k, fingerprint(paths) if paths else "", None, None, None))
                else:
                    mark, mapping = known[paths]
                    out.extend((c, mark, i, role, text) for c, i, role, text in record_turns(k, record, mapping))
            yield pd.DataFrame(out, columns=["conv_id", "layout", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})

    made = records.select(F.col(key).try_cast("long").alias("k"), F.col(payload).cast("string").alias("payload"))
    return made.mapInPandas(convert, "conv_id long, layout string, turn long, role string, text string")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: "\\" if len(m[0]) == 2 else "", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment and the span of its text there."""
    head = f"<s>{escape(role)}[INST] "
    body = escape(text)
    return f"{head}{body} [/INST]</s>", len(head), len(head) + len(body)


def read_turn(segment: str) -> tuple[str, str]:
    m = _SEGMENT.match(segment)
    if not m:
        raise ValueError("not a segment of this template")
    return unescape(m[1]), unescape(m[2])


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, turn, role, text`` to segments: ``conv_id, turn, segment, loss_from, loss_to``; joined in order they are the formatted text."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, a, b) if r == loss_role else (s, 0, 0) for r, t in zip(f["role"], f["text"], strict=True) for s, a, b in [format_turn(r, t)]]
            made = pd.DataFrame(rows, columns=["segment", "loss_from", "loss_to"])
            yield pd.concat([f[["conv_id", "turn", "role", "text"]].reset_index(drop=True)[["conv_id", "turn"]].astype("Int64"), made], axis=1)

    return turns.mapInPandas(write, "conv_id long, turn long, segment string, loss_from long, loss_to long")


def chat_digests(segments: DataFrame) -> DataFrame:
    """Reads segments back: per conversation its turns, loss text and lengths, as counts and SHA-256.

    Segments are read in order as a stream; only the running hashes of one conversation are held.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.col("segment")]
    dealt = segments.repartition("conv_id").sortWithinPartitions(*order)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = (), None

        def row() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return (key[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for f in frames:
            out = []
            ids = f["conv_id"].astype("Int64")
            for conv, segment, a, b in zip(ids, f["segment"], f["loss_from"], f["loss_to"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if (conv,) != key:
                    if state:
                        out.append(row())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(segment)
                state[1].update(f"{role}\n{text}\n".encode())
                lost = unescape(segment[int(a) : int(b)])
                state[3].update(lost.encode())
                state[0], state[2], state[4] = state[0] + 1, state[2] + len(lost), state[4] + len(segment)
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([row()], columns=columns).astype({"conv_id": "Int64"})

    return dealt.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
