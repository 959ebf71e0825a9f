"""Token ids of whole texts by public tokenizers, with each distinct word encoded once per worker.

Both tokenizers never merge across the start of a space-led word, so a text is cut before every space that a
non-space follows, the tokenizers library encodes the distinct pieces, and numpy puts the ids back in text order. Plain
words (Latin letters, then perhaps punctuation marks) go straight to the library's BPE model, all others
through its whole pipeline; the tests compare both with encoding the whole text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ptclake.llm.common import ragged

_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#%&$|]*)\Z")
_CUT = re.compile(r"(?<=.)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)", re.S)
#: a space before other white space starts no piece
_ODD = r" [\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| $"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself where printable, else the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class WordCachedEncoder:
    """Encodes texts with a tokenizers file; special tokens' strings count as ordinary text.

    ``limit`` bounds the pieces remembered in a worker; when it is reached, new pieces are encoded each time.
    """

    def __init__(self, path: str, limit: int = 1 << 18):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.limit, self.known = self.tokenizer.model, limit, {}
        self.letters: dict[str, bytes] = {}
        self.bytes = _byte_letters()
        form = json.loads(self.tokenizer.to_str())
        kinds = [form["normalizer"] and [x["type"] for x in form["normalizer"].get("normalizers", [form["normalizer"]])], form["pre_tokenizer"]["type"]]
        self.lower = kinds == [["NFC", "Replace", "Lowercase"], "Sequence"]
        #: other layouts of the file than the two known ones always take the library's pipeline for whole texts
        self.by_words = self.lower or kinds == [None, "ByteLevel"] and not form["pre_tokenizer"]["add_prefix_space"]

    def _run(self, run: str) -> bytes:
        found = self.letters.get(run)
        if found is None:
            tokens = self.model.tokenize(run.replace(" ", self.bytes[32]) if run.isascii() else "".join(map(self.bytes.__getitem__, run.encode())))
            found = array("I", [t.id for t in tokens]).tobytes()  # the machine is little-endian, as Arrow's buffers are
            if len(self.letters) < self.limit:
                self.letters[run] = found
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of one piece, little-endian unsigned 32-bit."""
        found = self.known.get(text)
        if found is not None:
            return found
        if m := _PLAIN.match(text):
            space, letters, marks = m.groups()
            found = self._run(letters.lower() if self.lower else space + letters)
            if marks:
                found += self._run(marks)
        elif len(parts := _CUT.split(text)) > 1:
            return b"".join(map(self.piece, parts))
        else:
            found = self._whole(text)
        if len(self.known) < self.limit and len(text) < 100:
            self.known[text] = found
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and the ids of all texts, each with ``end_id`` after it if given. No nulls in ``texts``."""
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        if not self.by_words:
            each = [self._whole(t) + tail for t in texts.to_pylist()]
            return np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int64), np.frombuffer(b"".join(each), "<u4")
        #: a text with runs of spaces, or one at its end, is one piece here and is cut by piece()
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        even = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(even, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # the first piece of a text has no space before it
        given = texts.to_pylist()
        firsts = [t if o else t.partition(" ")[0] for t, o in zip(given, odd.tolist(), strict=True)]
        codes[offsets[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        pieces = [self.piece(" " + w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()] + [self.piece(w) if t else b"" for w, t in zip(firsts, given, strict=True)] + [tail]
        lengths = np.fromiter((len(p) // 4 for p in pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        if tail:
            codes = np.insert(codes, offsets[1:], len(pieces) - 1)
            offsets = offsets + np.arange(len(offsets))
        each = lengths[codes]
        ids = np.frombuffer(b"".join(pieces), "<u4")[ragged(starts[codes], each)]
        return np.concatenate([[0], np.cumsum(each)])[offsets], ids


_ENCODERS: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """The worker's encoder for a file; it lives as long as the Python worker, over many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]
