"""Token ids of whole texts by a public tokenizer file.

The tokenizers library spends nearly all its time on merging the characters of
words it has met before, so a text is first cut exactly where the tokenizer's
own pattern always cuts, each distinct piece is encoded once per worker (a
bounded cache that outlives the task), and the pieces' ids are joined.
:func:`cut_rule` knows the two kinds of tokenizer for which that is exact; any
other is given whole texts. So is every text that holds the string of an added
token (``<|endoftext|>``), whose id the library puts there by default.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

END_ID = 2
CACHE_PIECES = 700_000
RUN_PIECES = 4096
# characters of the Unicode property White_Space (fixed values)
SPACE = "\t-\r \x85\xa0  -     　"
# letters and marks between which every known pattern cuts: no apostrophes, and
# no dotted capital I, which ends in a combining mark once lower-cased
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
MARKS = "-.,!?;:\"()#$%&*|=+/"
WORD = f"[{LETTERS}]+(?=[{SPACE}{MARKS[1:]}-]|\\Z)"
SIGNS = f"[{MARKS[1:]}-]+(?=[{SPACE}{LETTERS}]|\\Z)"
KEPT_SPACE = f" ?{WORD}| ?{SIGNS}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"
DROPPED_SPACE = f"{WORD}|{SIGNS}|[^{SPACE}]+"
# characters beyond which lower-casing first could change what NFC composes
BEYOND = re.compile("[^\x00-į\u0131-ɏ]")
# stands between pieces that are encoded in one call; one id of its own
BREAKS = {KEPT_SPACE: ("\n", "\n"), DROPPED_SPACE: ("\x1f", " \x1f ")}


def cut_rule(tokenizer: Tokenizer) -> re.Pattern | None:
    """Pattern of the pieces that the tokenizer always encodes on their own."""
    state = json.loads(tokenizer.to_str())
    before, normal = state["pre_tokenizer"] or {}, state["normalizer"] or {}
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
        return re.compile(KEPT_SPACE)
    steps, parts = normal.get("normalizers", []), before.get("pretokenizers", [])
    if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} \
            and len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" \
            and parts[0]["invert"] and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"]:
        return re.compile(DROPPED_SPACE)
    return None


class Encoder:
    """``ids(texts)``: little-endian unsigned 32-bit ids of each text; with
    ``special_as_text`` the strings of special tokens are ordinary text."""

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.rule = cut_rule(self.tokenizer)
        self.cache: dict[str, bytes] = {}
        self.lowers = self.rule is not None and self.rule.pattern == DROPPED_SPACE
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [t.content for t in added]
        if self.rule is not None and any(self.lowers and t.normalized or set(t.content) & set(BREAKS[self.rule.pattern][1])
                                         for t in added):
            self.rule, self.lowers = None, False  # one substring test would not find them all
        if self.rule is not None:
            self.mark, self.joint = BREAKS[self.rule.pattern]
            (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Many pieces in one call, with a mark between them (a call has a cost
        of its own); pieces of white space or with the mark go alone."""
        alone = [p for p in pieces if p.isspace() or self.mark in p]
        known = dict(zip(alone, self._encode(alone))) if alone else {}
        pieces = [p for p in pieces if p not in known] if alone else pieces
        if pieces:
            (found,) = self.tokenizer.encode_batch_fast([self.joint.join(pieces)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            raw, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            if len(starts) != len(pieces):
                raise ValueError("pieces and ids do not match")
            known.update((p, raw[s:e]) for p, s, e in zip(pieces, starts, ends))
        return known

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.rule is None:
            return self._encode(texts)
        given = texts
        if self.lowers:  # "The" and "the" are then one piece
            texts = [t if not t.isascii() and BEYOND.search(t) else t.lower() for t in texts]
        # lower-cased text too: "<|ENDOFTEXT|>" is no token, but its piece would be
        whole = [i for i, t in enumerate(texts) if any(a in t or a in given[i] for a in self.added)]
        if whole:
            apart = set(whole)
            out = self._ids_by_pieces([t for i, t in enumerate(texts) if i not in apart])
            for i, x in zip(whole, self._encode([given[i] for i in whole])):
                out.insert(i, x)
            return out
        return self._ids_by_pieces(texts)

    def _ids_by_pieces(self, texts: list[str]) -> list[bytes]:
        find, get = self.rule.findall, self.cache.get
        pieces = [find(t) for t in texts]
        parts = [list(map(get, p)) for p in pieces]
        short = [i for i, x in enumerate(parts) if None in x]
        todo = list({p for i in short for p, x in zip(pieces[i], parts[i]) if x is None})
        new: dict[str, bytes] = {}
        for at in range(0, len(todo), RUN_PIECES):
            new.update(self._encode_pieces(todo[at:at + RUN_PIECES]))
        for i in short:
            parts[i] = [new[p] if x is None else x for p, x in zip(pieces[i], parts[i])]
        if len(self.cache) + len(new) <= CACHE_PIECES:  # what comes first has the frequent pieces
            self.cache.update(new)
        return [b"".join(x) for x in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, with the ids of the library's defaults."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, special_as_text=False)
    return _ENCODERS[path]


def end_mark(end_id: int) -> bytes:
    return array("I", [end_id]).tobytes()
