"""Whole-text token ids by the ``tokenizers`` library, with an exact memo of the parts a text repeats.

A text is cut only where the tokenizer's own pre-tokenizer is certain to cut, so the ids of the parts,
joined, are the ids of the whole text.  Parts repeat (the commonest words are most of any text), so
each worker process remembers the ids of parts: in a table that is probed for a batch of texts at once, and
in small memos of the words inside parts.  Their limits bound memory and have no effect on results.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from .parttable import PartTable

MEMO_LIMIT, NEW_LIMIT = 30_000, 20_000
#: Bytes of texts whose parts are looked up together.
GROUP_BYTES = 250_000
#: The id appended to every document.
END_ID = 0

_BARE, _SPACED = 0, 1
_IS_BLANK = np.array([c in b" \t\n\v\f\r" for c in range(256)])
_encoders: dict[str, TextEncoder] = {}
#: White space before a space: with more white space after it a byte-level pre-tokenizer may join the
#: two, so such texts are encoded uncut.
_ASCII_BEFORE_SPACE = tuple(bytes([c, 32]) for c in (32, 10, 13, 9, 11, 12, 28, 29, 30, 31))
_BEFORE_SPACE = re.compile(r"\s ")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file, made on first use."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _byte_alphabet() -> str:
    """The printable stand-in for each byte that byte-level tokenizers use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class _Memo(dict):
    """Part (UTF-8, without the leading space that ``lead`` stands for) -> its ids as little-endian bytes.

    ``__missing__`` asks the library.  ``bare`` is the memo of parts without a leading space.
    """

    def __init__(self, library, kind: str, lead: str, lower: bool, bare: _Memo | None = None) -> None:
        super().__init__()
        self.library, self.model, self.kind, self.lead, self.lower, self.bare = library, library.model, kind, lead, lower, bare
        self.new: dict[bytes, bytes] = {}
        alphabet = _byte_alphabet()
        self.symbols = str.maketrans({i: c for i, c in enumerate(alphabet)})
        self.head = alphabet[32] if lead else ""
        self.stop, self.comma, self.line = (self._whole(x) for x in (".", ",", "\n"))

    def __missing__(self, part: bytes) -> bytes:
        ids = self.new.pop(part, None)
        if ids is not None:
            if len(self) < MEMO_LIMIT:
                self[part] = ids
            return ids
        ids = self._find(part)
        if len(self.new) >= NEW_LIMIT:
            self.new.clear()
        self.new[part] = ids
        return ids

    def ids_of(self, part: bytes) -> bytes:
        """Ids of a part that is remembered elsewhere."""
        return self._find(part) if part or self.lead else b""

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _find(self, part: bytes) -> bytes:
        text = part.decode()
        if text.isascii():
            if text.isalpha():  # one pre-token: straight to the model, as the library would after normalising
                return array(self.kind, [t.id for t in self.model.tokenize(self.head + (text.lower() if self.lower else text))]).tobytes()
        elif text.isalpha() and max(text) < "\u0100":
            raw = text.lower().encode() if self.lower else part
            return array(self.kind, [t.id for t in self.model.tokenize(self.head + raw.decode("latin-1").translate(self.symbols))]).tobytes()
        if text[-1:] in (".", ",") and text[:-1].isalpha() and max(text) < "\u0100":  # letters and marks are always cut apart
            return self[part[:-1]] + (self.stop if text[-1] == "." else self.comma)
        if self.bare is not None and "\n" in text:
            # Between two other characters a line break is a pre-token of its own.
            first, *rest = text.split("\n")
            if all(x.split() == [x] for x in (first, *rest)):
                return self[first.encode()] + b"".join(self.line + self.bare[x.encode()] for x in rest)
        return self._whole(self.lead + text)


class TextEncoder:
    """Ids of whole texts as numpy arrays, as ``encode(text, add_special_tokens=False)`` of the file's tokenizer gives them.

    So the string of a special token in a text is that token; such texts are encoded uncut.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.item = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.cut = _cut_rule(json.load(f))
        added = self.library.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):  # found in normalised text only
            self.cut = None
        # Parts are folded before they are looked up, so a folded string must not be met there either.
        self.special = [t.content.encode().lower() for t in added]
        kind = "H" if self.item.itemsize == 2 else "I"
        self.bare = _Memo(self.library, kind, "", self.cut == "white space")
        if self.cut == "before spaces":
            self.bare.bare = self.bare
        self.spaced = _Memo(self.library, kind, " ", False, self.bare)
        self.table = PartTable(lambda part, kind: (self.spaced if kind == _SPACED else self.bare).ids_of(part), self.item)

    def ids(self, data: bytes) -> np.ndarray:
        """Ids of a whole text in UTF-8."""
        return self.many([data])[0]

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts, in order."""
        out: list[np.ndarray | None] = [None] * len(texts)
        at: list[int] = []
        size = 0
        for i, data in enumerate(texts):
            if not data:
                out[i] = np.empty(0, dtype=self.item)
            elif not self.cut or (self.cut == "before spaces" and _spaced_out(data)) or self._names_special(data):
                out[i] = np.array(self.library.encode(data.decode(), add_special_tokens=False).ids, dtype=self.item)
            else:
                at.append(i)
                size += len(data)
                if size >= GROUP_BYTES:
                    self._group(texts, at, out)
                    at, size = [], 0
        if at:
            self._group(texts, at, out)
        return out

    def _names_special(self, data: bytes) -> bool:
        folded = data.lower()
        return any(x in folded for x in self.special)

    def _group(self, texts: list[bytes], at: list[int], out: list) -> None:
        """Look up the parts of some texts together and deal the ids out again."""
        joined = b" ".join([texts[i] for i in at])
        begins = np.cumsum([0, *[len(texts[i]) + 1 for i in at[:-1]]])
        if self.cut == "white space":  # of a case-folding tokenizer, so A-Z may be folded first
            joined = joined.lower()
            blank = _IS_BLANK[np.frombuffer(joined, dtype=np.uint8)]
            edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
            start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
            kind = np.full(start.size, _BARE)
            first = np.searchsorted(start, begins)
        else:
            spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
            start, end = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(joined)]])
            first = np.searchsorted(start, begins)
            kind = np.full(start.size, _SPACED)
            kind[first] = _BARE
        ids, count = self.table.encode(joined, start, end, kind)
        before = np.concatenate([[0], np.cumsum(count)])
        for i, x in zip(at, np.split(ids, before[first[1:]]), strict=True):
            out[i] = x

    def documents(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """For each text its ids and the end id, in the smallest unsigned type that holds them; null counts as empty."""
        for ids in self.many([t or b"" for t in texts]):
            out = np.empty(ids.size + 1, dtype=self.item)
            out[:-1] = ids
            out[-1] = END_ID
            yield out

    def document(self, data: bytes | None) -> np.ndarray:
        return next(self.documents([data]))


def _spaced_out(data: bytes) -> bool:
    return any(map(data.__contains__, _ASCII_BEFORE_SPACE)) or (not data.isascii() and _BEFORE_SPACE.search(data.decode()) is not None)


def _cut_rule(spec: dict) -> str | None:
    """Where texts may be cut for this tokenizer; None: nowhere that is known to be safe."""
    pre, normal, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if model["type"] != "BPE" or spec.get("post_processor") or model.get("continuing_subword_prefix"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
        return "before spaces"
    steps = [p["type"] for p in pre.get("pretokenizers", [])]
    splits = next((p for p in pre.get("pretokenizers", []) if p["type"] == "Split"), {})
    lower = [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if steps == ["Split", "ByteLevel"] and splits.get("invert") and splits.get("behavior") == "Removed" and lower and r"[^\s\p{L}\p{N}]+" in splits["pattern"].get("Regex", ""):
        return "white space"
    return None
