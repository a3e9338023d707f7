"""Ids of the public tokenizers for whole texts, exact and in bounded parts.

Both tokenizers are loaded from files given by a parameter. The byte-level
vocabulary's merges are applied by its equal rank form where the merge order is
the id order (checked when it is loaded; several times faster), else by the
library of the file. A text above ``PART_BYTES`` is encoded in parts, cut in
front of a space that follows a character other than white space: no token of
either vocabulary crosses such a place (the byte-level pattern ends a match
there; no piece holds a space behind another character, which is checked), so
the ids are those of the whole text.
"""

from __future__ import annotations

import json

import numpy as np

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
PART_BYTES = 1 << 18

#: Fixed value: the pattern that splits a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions of spaces behind a character that surely isn't white space: printable
    ASCII, or one whose lead byte has no white space under it (of two bytes it starts
    with C3 or more, of three with E4 or more)."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]

    def back(k: int) -> np.ndarray:
        return np.where(at >= k, data[np.maximum(at - k, 0)], 0)

    def tail(k: int) -> np.ndarray:
        return (back(k) >= 0x80) & (back(k) < 0xC0)

    last, two, three, four = back(1), back(2), back(3), back(4)
    return at[((last > 0x20) & (last < 0x7F))
              | tail(1) & ((two >= 0xC3) & (two <= 0xDF) | tail(2) & ((three >= 0xE4) & (three <= 0xEF) | tail(3) & (four >= 0xF0)))]


def parts(text: str, limit: int = PART_BYTES) -> list[str]:
    """The text in parts of about ``limit`` bytes, cut where no token crosses."""
    if len(text) <= limit // 4:
        return [text]
    raw = text.encode()
    if len(raw) <= limit:
        return [text]
    at = cuts(np.frombuffer(raw, np.uint8))
    edges = [0]
    while len(raw) - edges[-1] > limit:
        k = int(np.searchsorted(at, edges[-1] + limit, "right")) - 1
        if k < 0 or at[k] <= edges[-1]:  # no cut within the limit: the next one
            k = int(np.searchsorted(at, edges[-1], "right"))
        if k >= len(at):
            break
        edges.append(int(at[k]))
    return [raw[a:z].decode() for a, z in zip(edges, [*edges[1:], len(raw)], strict=True)]


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character in a byte-level vocabulary: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Byte-level tokenizer from its JSON; no tokens are added. ``plain_specials``: the
    strings of special tokens inside a text are ordinary text, else they are those tokens."""

    def __init__(self, spec: str, plain_specials: bool) -> None:
        from tokenizers import Tokenizer
        self.plain = plain_specials
        tok = self.library = Tokenizer.from_str(spec)
        tok.no_padding()
        tok.no_truncation()
        tok.encode_special_tokens = plain_specials
        alphabet = byte_level_alphabet()
        added = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
        self.bytes = [added[i] if i in added else bytes(alphabet[c] for c in tok.id_to_token(i)) for i in range(tok.get_vocab_size())]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.ranked = self._ranks(json.loads(spec), added)

    def _ranks(self, spec: dict, added: dict[int, bytes]):
        """Rank form of the same vocabulary, or None where it would differ."""
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"].get(a + b) for a, b in pairs]
        same = (order == list(range(256, 256 + len(order))) and spec["normalizer"] is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("ignore_merges"))
        if not same:
            return None
        import tiktoken
        return tiktoken.Encoding("byte_level", pat_str=PATTERN, special_tokens={t.decode(): i for i, t in added.items()},
                                 mergeable_ranks={b: i for i, b in enumerate(self.bytes) if i not in added})

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a whole text (int32)."""
        found = []
        for p in parts(text):
            if self.ranked is None:
                found.append(np.array(self.library.encode(p, add_special_tokens=False).ids, np.int32))
            else:
                found.append(self.ranked.encode_to_numpy(p, allowed_special=set() if self.plain else "all",
                                                         disallowed_special=()).astype(np.int32))
        return found[0] if len(found) == 1 else np.concatenate(found)


class PieceBpe:
    """Piece tokenizer from its model file's bytes; it puts a space before a text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} holds a space behind another character")
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a whole text (int32); a part after the first starts with the space
        that the library adds anew."""
        found = [np.array(self.library.encode(p[1:] if k else p, num_threads=1), np.int32) for k, p in enumerate(parts(text))]
        return found[0] if len(found) == 1 else np.concatenate(found)
