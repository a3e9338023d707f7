r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with character offsets.
Turn spans and token spans are both sorted, so a binary search tells which
tokens lie in an assistant text; those carry the loss mask.

Template: ``[INST] user text [/INST]``, ``assistant text</s>`` and, for any
other role, ``[ROLE] role\ntext[/ROLE]``; a conversation starts with ``<s>``.
Inside texts and roles a backslash is doubled and a control string gets a
backslash after its first character, so every text can be read back exactly.
The control strings are added tokens: no token crosses the edge of a text.

A long conversation is rendered in parts cut between turns (control tokens, so
the tokens are those of the whole), and turns stream through a sorted
partition: memory is bounded by one part, not by a conversation.

Defined results: null texts and roles are empty, a null ``turn`` sorts first,
equal turns sort by role and text, null ``conv_id`` is a conversation of its
own, repeated rows are repeated turns, an empty table gives no rows, other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PART_CHARS = 1 << 16
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

_FIND = re.compile("|".join(re.escape(c) for c in CONTROL))
_FORMATTED = ("conv_id long, part int, last boolean, text string, input_ids array<int>, loss_mask array<tinyint>, "
              "token_starts array<int>, token_ends array<int>")
_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, n_tokens long, n_loss_tokens long")


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """Rendered turn and the span of its text."""
    body = escape(text)
    if role == "user":
        head, tail = "[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = "", "</s>"
    else:
        head, tail = f"[ROLE] {escape(role).replace(chr(10), chr(92) + 'n')}\n", "[/ROLE]"
    return head + body + tail, len(head), len(head) + len(body)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every rendered turn; start and end are those of the escaped text."""
    at = len("<s>") if text.startswith("<s>") else 0
    while at < len(text):
        if text.startswith("[INST] ", at):
            a, z = at + 7, text.index(" [/INST]", at + 6)
            role, end = "user", z + 8
        elif text.startswith("[ROLE] ", at):
            nl = text.index("\n", at)
            role = _unescape_role(text[at + 7:nl])
            a, z = nl + 1, text.index("[/ROLE]", nl)
            end = z + 7
        else:
            a, z = at, text.index("</s>", at)
            role, end = "assistant", z + 4
        yield role, unescape(text[a:z]), a, z
        at = end


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def load_tokenizer(spec: str):
    """Tokenizer from its JSON, with the template's control strings as added tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors
    tok = Tokenizer.from_str(spec)
    tok.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for tokens inside one of the sorted, disjoint spans: the last span that
    starts at or before the token is found by binary search."""
    mask = np.zeros(len(offsets), np.int8)
    if len(spans) and len(offsets):
        k = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
        mask[(k >= 0) & (offsets[:, 1] <= spans[k, 1]) & (offsets[:, 1] > offsets[:, 0])] = 1
    return mask


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for b in batches:
        for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            yield conv, role or "", text or ""


def _format(shared, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(shared.value)
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("text", pa.string()),
                            ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())),
                            ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32()))])

        def encoded(rows: list[tuple]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in schema]
            for (conv, part, last, text, spans), e in zip(rows, tok.encode_batch([r[3] for r in rows], add_special_tokens=False), strict=True):
                offs = np.array(e.offsets, np.int32).reshape(-1, 2)
                mask = loss_mask(offs, np.array(spans, np.int64).reshape(-1, 2))
                for c, v in zip(cols, (conv, part, last, text, e.ids, mask, offs[:, 0], offs[:, 1]), strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        none = object()
        conv, part, pieces, spans, size, waiting = none, 0, [], [], 0, 0

        def close(last: bool) -> None:
            nonlocal part, pieces, spans, size, waiting
            rows.append((conv, part, last, "".join(pieces), spans))
            waiting += size
            part, pieces, spans, size = part + 1, [], [], 0

        for c, role, text in _turns(batches):
            if c != conv or conv is none:
                if conv is not none:
                    close(True)
                conv, part, pieces, spans, size = c, 0, ["<s>"], [], 3
            elif size >= part_chars:
                close(False)
            shown, a, z = render_turn(role, text)
            if role == "assistant" and z > a:
                spans.append((size + a, size + z))
            pieces.append(shown)
            size += len(shown)
            if waiting >= part_chars:
                yield encoded(rows)
                rows, waiting = [], 0
        if conv is not none:
            close(True)
        if rows:
            yield encoded(rows)
    return run


def format_chat(conversations: DataFrame, tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per part of a conversation, in order inside a partition:
    conv_id, part, last, text, input_ids, loss_mask and token offsets."""
    with open(tokenizer, encoding="utf-8") as f:  # a few MB, shipped to the tasks
        shared = conversations.sparkSession.sparkContext.broadcast(f.read())
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                 F.col("role").cast("string"), F.col("text").cast("string"))
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_format(shared, part_chars), _FORMATTED))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _DIGEST.split(", ")]
    state = None
    for b in batches:
        done: list[tuple] = []
        cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
        for i in range(len(b)):
            if state is None:
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            text = cols["text"][i].as_py()
            for role, body, _, _ in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            mask = np.asarray(cols["loss_mask"][i].values)
            on = np.flatnonzero(mask)
            a = np.asarray(cols["token_starts"][i].values)[on]
            z = np.asarray(cols["token_ends"][i].values)[on]
            # join masked tokens to character ranges; tokens of one character share it
            cut = np.flatnonzero(a[1:] > z[:-1]) + 1
            for lo, hi in zip(a[np.concatenate([[0], cut])] if len(a) else [], z[np.concatenate([cut - 1, [-1]])] if len(a) else [], strict=True):
                body = unescape(text[lo:hi])
                state[2] += len(body)
                state[3].update(body.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
            state[5] += len(mask)
            state[6] += len(on)
            if cols["last"][i].as_py():
                done.append((cols["conv_id"][i].as_py(), state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
                state = None
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)),
                                             schema=pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the output of :func:`format_chat`
    (turns parsed from the text, loss text taken through the token mask)."""
    return formatted.mapInArrow(_read_back, _DIGEST)
