"""Exact token ids of whole texts from the public tokenizer files, one library call per distinct unit of text.

Both tokenizer kinds never merge across a white-space character that follows a visible one: the byte-level pattern starts
a new pre-token there, and the piece model has no piece with its space mark behind another character (checked when it is
loaded). So a text may be cut there, and each distinct unit is given to the library once. Where the visible character is
not plainly known to be no white space (anything but ASCII and two-byte letters), no cut is made; units only get longer.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

from emberscan.llm.batches import Joined

#: Distinct units a worker remembers before it starts anew.
REMEMBERED = 1_500_000
#: Bytes of text whose units are collected together.
TEXT_CHUNK = 4 << 20

_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_FIRST = np.uint64(0x5851F42D4C957F2D)


class Encoder:
    """Ids of texts under one tokenizer file (a name of the public tokenizers, or a path)."""

    def __init__(self, name: str):
        path = locate(name)
        self.piecewise = path.endswith(".model")
        self.cut_at = np.zeros(256, bool)
        if self.piecewise:
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
            self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces) and all(
                self.model.encode(x, out_type=str) == y for x, y in (("a b", ["▁a", "▁b"]), ("a ", ["▁a", "▁"])))
            self.cut_at[0x20] = self.cuttable
        else:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            pre = str(self.model.pre_tokenizer)
            self.cuttable = self.model.normalizer is None and "ByteLevel" in pre and "use_regex=True" in pre and "add_prefix_space=False" in pre
            # In the byte-level alphabet a token has a character for each of its bytes.
            self.widths = np.ones(self.model.get_vocab_size(), np.int64)
            for token, i in self.model.get_vocab().items():
                self.widths[i] = len(token)
            self.specials = [x.content.encode() for x in self.model.get_added_tokens_decoder().values()]
            self.cut_at[[0x20, 0x0A, 0x09, 0x0D]] = self.cuttable
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.offsets = np.zeros(1, np.int64)
        self.order = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, units: list[str], first: np.ndarray) -> list[list[int]]:
        if not self.piecewise:
            return self._encode_joined(units) if self.cuttable else [
                x.ids for x in self.model.encode_batch(units, add_special_tokens=False)]
        # The model puts its space mark before what it is given: that is the space a later unit begins with.
        given = [u if f else u[1:] for u, f in zip(units, first, strict=True)]
        out = self.model.encode(given, num_threads=1)
        mark = self.model.piece_to_id("▁")
        return [[mark] if not f and not g else ids for f, g, ids in zip(first, given, out, strict=True)]

    def _encode_joined(self, units: list[str]) -> list[list[int]]:
        """Units that begin with a space and end in a visible character may follow each other in one call; the ids of
        each are found again by the bytes they stand for. The rest go one by one."""
        raw = [u.encode() for u in units]
        out: list[list[int] | None] = [None] * len(units)
        chain = [i for i, u in enumerate(raw) if u[0] == 0x20 and (0x20 < u[-1] < 0x7F or u[-1] >= 0x80 and 0xC3 <= u[-2] <= 0xDF)]
        groups = [chain[lo:lo + 512] for lo in range(0, len(chain), 512)]
        together = self.model.encode_batch_fast(["".join([units[i] for i in some]) for some in groups], add_special_tokens=False)
        for some, encoding in zip(groups, together, strict=True):
            ids = encoding.ids
            ends = np.cumsum([len(raw[i]) for i in some])
            reached = np.cumsum(self.widths[ids])
            stops = np.searchsorted(reached, ends) + 1
            if stops[-1] == len(ids) and np.array_equal(reached[stops - 1], ends):
                stops = stops.tolist()
                for i, lo, hi in zip(some, [0, *stops[:-1]], stops, strict=True):
                    out[i] = ids[lo:hi]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.model.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _units(self, joined: Joined) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, document, and is-first flag of every unit; each text with bytes has at least one."""
        data = joined.bytes
        before, second = np.empty_like(data), np.empty_like(data)
        before[0], second[:2] = 0x0A, 0x0A
        before[1:], second[2:] = data[:-1], data[:-2]
        visible = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (second >= 0xC3) & (second <= 0xDF))
        cuts = self.cut_at[data] & visible
        if not self.piecewise and self.cuttable and not any(x in joined.raw for x in self.specials):
            # The pattern also starts a new pre-token where punctuation follows a letter.
            cuts |= _PUNCTUATION[data] & _LETTER[before]
        cuts[joined.ends] = False
        full = joined.ends > joined.starts
        cuts[joined.starts[full]] = True
        starts = np.flatnonzero(cuts)
        owner = joined.owner(starts)
        first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool)
        ends = np.concatenate((starts[1:], [0])) if len(starts) else starts
        last = np.concatenate((first[1:], [True])) if len(owner) else first
        ends = np.where(last, joined.ends[owner], ends)
        return starts, ends, owner, first

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token count per text, and for each unit occurrence its index into `self.offsets` (see `flat_ids`)."""
        joined = Joined(texts)
        starts, ends, owner, first = self._units(joined)
        if not len(starts):
            return np.zeros(len(texts), np.int64), np.empty(0, np.int64)
        prints = joined.fingerprints(starts, ends)
        if self.piecewise:
            # " x" at the start of a text is not the " x" inside one.
            prints = np.where(first, prints ^ _FIRST, prints)
        distinct, index, inverse = np.unique(prints, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        new = ~self._holds(distinct)
        if new.any():
            at = index[new]
            raw = joined.raw
            units = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            found = self._encode(units, first[at])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            slots = np.concatenate([self.order, np.arange(len(self.known), len(self.known) + len(at))])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.order = known[order], slots[order]
        slot = self.order[np.searchsorted(self.known, distinct)][inverse]
        counts = np.bincount(owner, weights=(self.offsets[slot + 1] - self.offsets[slot]), minlength=len(texts))
        return counts.astype(np.int64), slot

    def _holds(self, prints: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(prints), bool)
        at = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        return self.known[at] == prints

    def flat_ids(self, slot: np.ndarray) -> np.ndarray:
        """The ids of all unit occurrences, one after the other."""
        lengths = self.offsets[slot + 1] - self.offsets[slot]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[slot] - (ends - lengths), lengths)
        return self.ids[at]


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def locate(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def version_digest(name: str) -> str:
    """Names a tokenizer version: its file's bytes and the library's release."""
    from importlib.metadata import version
    library = "sentencepiece" if name.endswith(".model") else "tokenizers"
    with open(locate(name), "rb") as file:
        return hashlib.sha256(file.read() + f"{library} {version(library)}".encode()).hexdigest()
