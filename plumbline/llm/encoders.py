"""Token ids of whole texts, with a bounded memo of the units that no merge crosses.

Both models are asked through their own libraries. A text is cut only at places where every token
must end anyway, and each distinct unit between two cuts is encoded once per worker:

* byte-level BPE: its pre-tokens never run on from a character that is no white space into a
  single space before another such character, so those spaces are cuts. The text of a special
  token holds no space, hence lies within one unit.
* the piece model: words and the spaces before them, see ``tokens.proven_words``.

Ids travel packed, as little-endian unsigned 32-bit numbers, so joining units is joining bytes.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm.tokens import MARK, pre_tokens, proven_words

#: A worker forgets its units once they hold more characters than this.
MEMO_CHARS = 5_000_000
#: Units longer than this are encoded anew each time.
LONG_UNIT = 64
#: So many unknown units are encoded as one text.
TOGETHER = 200
IDS = np.dtype("<u4")

#: A space with something other than white space on both sides.
CUT = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r"\s\s")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, IDS).tobytes()


class Memo:
    """Packed ids of units; what isn't known is encoded in one call of the library."""

    def __init__(self, encode):
        self.encode, self.known, self.held = encode, {}, 0

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """For each list of units the packed ids of all of them."""
        if self.held > MEMO_CHARS:
            self.known, self.held = {}, 0
        known = self.known
        new = [u for u in set().union(*lists) if u not in known]
        if new:
            known.update(zip(new, self.encode(new), strict=True))
            self.held += sum(map(len, new))
        found = [b"".join(map(known.__getitem__, units)) for units in lists]
        for unit in new:
            if len(unit) > LONG_UNIT:
                del known[unit]
                self.held -= len(unit)
        return found


def space_units(text: str) -> list[str]:
    """The units of a text for byte-level BPE; all but the first have lost the space before them."""
    if not UNEVEN.search(text) and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return CUT.split(text)


class BytePairs:
    """Byte-level BPE of the tokenizers library."""

    def __init__(self, path: str, plain: bool):
        """``plain``: strings of special tokens inside texts are ordinary text."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        marks = [t["content"] for t in spec["added_tokens"]]
        loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError("units can only be cut for a byte-level model without normaliser and added space")
        if loose or any(re.search(r"\s", m) for m in marks):
            raise ValueError("a special token reaches across a space")
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = plain
        self.lengths = np.array([len(b) for b in self.token_bytes()])
        self.first, self.rest = Memo(self._whole), Memo(self._spaced)

    def _whole(self, units: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(units, add_special_tokens=False)
        return [packed(e.ids) for e in found]

    def _spaced(self, units: list[str]) -> list[bytes]:
        """Units with the space before them, many at a time as one text whose ids are cut where a unit ends.

        Where white space at an end of a unit would change the cuts, each is encoded alone.
        """
        found = []
        for i in range(0, len(units), TOGETHER):
            part = units[i : i + TOGETHER]
            line = " " + " ".join(part)
            if UNEVEN.search(line) or line[-1].isspace():
                found += self._whole([" " + u for u in part])
                continue
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, IDS)
            sizes = list(map(len, part)) if line.isascii() else [len(u.encode()) for u in part]
            places = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.array(sizes) + 1)) + 1
            places, run = [0, *(places * IDS.itemsize).tolist()], ids.tobytes()
            found += [run[a:b] for a, b in zip(places, places[1:], strict=False)]
        return found

    def ids(self, texts: list[str], spaced: bool = False) -> list[bytes]:
        """Packed ids of each text; ``spaced`` puts a space before each of them."""
        lists = [space_units(t) for t in texts]
        if spaced:
            # The added space is a cut only if a character other than white space follows it.
            odd = [not t or t[0].isspace() for t in texts]
            heads = self.first.joined([[" " + u[0]] if o else [] for o, u in zip(odd, lists, strict=True)])
            tails = self.rest.joined([u[1:] if o else u for o, u in zip(odd, lists, strict=True)])
        else:
            heads = self.first.joined([u[:1] for u in lists])
            tails = self.rest.joined([u[1:] for u in lists])
        return [a + b for a, b in zip(heads, tails, strict=True)]

    def token_bytes(self) -> list[bytes]:
        """The bytes each id stands for. Byte-level vocabularies write a byte as one visible character."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
        names = sorted(self.model.get_vocab(with_added_tokens=True).items(), key=lambda v: v[1])
        if [i for _, i in names] != list(range(len(names))):
            raise ValueError("token ids have gaps")
        return [bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n, _ in names]


class Pieces:
    """The piece model of the sentencepiece library, which puts a space before each text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proven_words(self.model)
        self.space = packed([self.model.piece_to_id(MARK)])
        self.memo = Memo(self._whole)

    def _whole(self, units: list[str]) -> list[bytes]:
        """A unit has lost the space before it; alone, the library takes an empty one for no text."""
        found = self.model.encode(units, num_threads=1)
        return [packed(ids) if unit else self.space for unit, ids in zip(units, found, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.memo.joined([[t] if MARK in t else pre_tokens(t) for t in texts])

    def token_bytes(self) -> list[bytes]:
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>").fullmatch
        return [bytes.fromhex(m[1]) if (m := byte(n)) else n.replace(MARK, " ").encode() for n in names]


@lru_cache(maxsize=4)
def byte_pairs(path: str, plain: bool) -> BytePairs:
    return BytePairs(path, plain)


@lru_cache(maxsize=2)
def piece_model(path: str) -> Pieces:
    return Pieces(path)


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, IDS)
