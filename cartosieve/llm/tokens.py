"""Token ids of whole texts by the tokenizers library, with a bounded memory of the segments seen before.

Byte-pair merges never cross the pre-tokeniser's pieces, so a text's ids are those of its segments, joined. Two cuts are
known to be safe: "words" (for tokenisers that drop white space: at any white space) and "spaces" (for byte-level ones: a
segment is a word and the one space before it). A batch is cut by Arrow and each of its distinct segments looked up once; those
that are not remembered go to the library's merges in one call, their pieces already cut. Texts with other white space than
single spaces and line feeds are cut one by one. Those in which the library and Python may disagree on what is white space, or
that hold the text of a special token, go to the library whole, as do segments with characters whose classes they may see
differently.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FIRST, AFTER_LINE = "\1", "\2"
#: Python counts the first of these as white space, the library does not; the next are our marks.
UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", FIRST, AFTER_LINE, "<|")
SEGMENT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
OTHER_SPACE = tuple(c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n")
UNEVEN_SPACE = ("  ", "\n\n", " \n", "\n ", *OTHER_SPACE)
#: Segments in which Python's classes of characters, lower case and NFC are the library's: printable ASCII and Latin letters.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+")
#: The pre-tokenisers' pieces of such a segment.
PIECES = {
    "words": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+"),
    "spaces": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+"),
}


def _byte_letters() -> np.ndarray:
    """Byte-level tokenisers write each byte as a printable letter: itself, or the next free one from U+0100. Here 10 stays and 0 is a line feed's letter."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return np.array([letter[10], *(letter[b] for b in range(1, 10)), 10, *(letter[b] for b in range(11, 256))], "<u2")


BYTE_LETTERS = _byte_letters()


class SegmentEncoder:
    """encode_all(texts) -> ids of each as bytes ('<u4'), the same as the library's for the whole text."""

    def __init__(self, path: str, cut: str, room: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.merges, self.room = Tokenizer.from_file(path), Tokenizer.from_file(path), room
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit("\n")
        self.pieces, self.words = PIECES[cut], cut == "words"
        self.memo: dict[str, bytes] = {}
        if self.words:  # segments are told apart by a line feed's id between them
            self.between, found = "\n\0\n", self._merged("\0")
            if len(found) != 1:
                raise ValueError("the tokeniser has no id for a line feed")
            self.border = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.border[found] = True
        else:  # and here by the space that only their first piece begins with
            space, self.between = chr(BYTE_LETTERS[32]), "\n"
            vocabulary = self.tokenizer.get_vocab()
            self.border = np.zeros(len(vocabulary), bool)
            self.border[[i for piece, i in vocabulary.items() if piece.startswith(space)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, pieces: str) -> np.ndarray:
        letters = BYTE_LETTERS[np.frombuffer(pieces.encode(), np.uint8)].tobytes().decode("utf-16-le")
        return np.array(self.merges.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _unplain(self, segment: str) -> bytes:
        if self.words:
            return self.whole(segment)
        if segment[:1] == FIRST:
            return self.whole(segment[1:])
        return self.whole("\n" + segment[1:] if segment[:1] == AFTER_LINE else " " + segment)

    def _learn(self, segments: list[str]) -> None:
        """Remembers the ids of new segments."""
        lead, cut = "" if self.words else " ", self.pieces.findall
        plain, pieces = [], []
        for segment in segments:
            if PLAIN.fullmatch(segment):
                plain.append(segment)
                shown = lead + (segment.lower() if self.words else segment)
                pieces.append(shown if segment.isalpha() else "\n".join(cut(shown)))
            else:
                self.memo[segment] = self._unplain(segment)
        if plain:
            ids = self._merged(self.between.join(pieces))
            at = np.flatnonzero(self.border[ids])
            raw, last = ids.tobytes(), 4 * len(ids)
            begins, ends = ([0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), last]) if self.words else ((4 * at).tolist(), [*(4 * at[1:]).tolist(), last])
            self.memo.update(zip(plain, [raw[a:b] for a, b in zip(begins, ends, strict=True)], strict=True))

    def _known(self, segments: list[str]) -> list[bytes]:
        """The ids of distinct segments. When full, the memory starts anew."""
        if len(self.memo) >= self.room:
            self.memo.clear()
        found = list(map(self.memo.get, segments))
        new = [s for s, ids in zip(segments, found, strict=True) if ids is None]
        if new:
            self._learn(new)
            found = list(map(self.memo.__getitem__, segments))
        return found

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts whose segments stand between single spaces."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, code = np.frombuffer(b"".join(known), "<u4"), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins, size = (np.cumsum(sizes) - sizes)[code], sizes[code]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = ids[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], size)].tobytes()
        bounds = (4 * ends[np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        ready = []
        for i, text in enumerate(texts):
            if any(mark in text for mark in UNSURE):
                out[i] = self.whole(text)
            elif self.words:
                ready.append((i, " ".join(text.split()) if any(space in text for space in OTHER_SPACE) else text.replace("\n", " ")))
            elif any(pair in text for pair in UNEVEN_SPACE):
                out[i] = b"".join([self._known([s[1:]] if s[0] == " " and len(s) > 1 and not s.isspace() else [FIRST + s])[0] for s in SEGMENT.findall(text)])
            else:
                ready.append((i, FIRST + text.replace("\n", " " + AFTER_LINE)))
        if ready:
            at, shown = zip(*ready, strict=True)
            for i, ids in zip(at, self._joined(list(shown)), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, cut: str) -> SegmentEncoder:
    """One for each Python worker, kept between tasks."""
    return SegmentEncoder(path, cut)


def ends_sentence(path: str) -> np.ndarray:
    """For each id, whether its piece ends a sentence or line."""
    tokenizer = encoder(path, "spaces").tokenizer
    flags = np.zeros(tokenizer.get_vocab_size(), bool)
    for piece, i in tokenizer.get_vocab().items():
        flags[i] = piece[-1:] in (".", "!", "?", "Ċ", "。", "\n")
    return flags
