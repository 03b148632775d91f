"""Encoding with the tokenizers library, remembering what pieces of text become."""

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_pieces(text: str) -> list[str]:
    """Pieces for a tokenizer that drops white space: none of its rules looks across a blank.

    Blank and line feed are white space to every library; all else is left to the tokenizer.
    """
    return text.replace("\n", " ").split(" ")


_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")


def blank_pieces(text: str) -> list[str]:
    """Pieces for byte-level BPE whose words may start with one blank.

    A blank after a character that is not white space always starts a new word of the
    pattern, and the pattern looks back at nothing, so the pieces encode as the whole does.
    """
    if "  " in text or " \n" in text or " \t" in text or not text.isprintable():
        return _BEFORE_BLANK.split(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + p for p in rest if p] + [" "] * (text.endswith(" "))


# Letters, digits and white space of the first 256 characters, as the patterns of the tokenizers have them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: The words of the two patterns in texts of these characters: white space dropped, or one blank kept before a word.
_PATTERNS = {
    word_pieces: re.compile(rf"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
    blank_pieces: re.compile(rf"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
}


class Words(dict):
    """Ids of the words of a pattern as packed bytes, from the tokenizer's model; each is asked once, up to a bound in bytes."""

    def __init__(self, tokenizer, code: str, most_bytes: int):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenize, self.code, self.most_bytes, self.held = tokenizer.model.tokenize, code, most_bytes, 0
        # byte-level models see bytes as characters: those that cannot be shown are moved up, in order
        moved = (b for b in range(256) if chr(b) not in ByteLevel.alphabet())
        self.shown = {b: 256 + n for n, b in enumerate(moved)}

    def __missing__(self, word: str) -> bytes:
        if self.held > self.most_bytes:
            self.clear()
            self.held = 0
        seen = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.shown)
        ids = array(self.code, [t.id for t in self.tokenize(seen)]).tobytes()
        if len(word) <= Pieces.LONG_CHARS:
            self[word] = ids
            self.held += len(word) + len(ids) + Pieces.ENTRY_BYTES
        return ids


class Pieces(dict):
    """Ids of pieces of text as packed bytes: each new piece is encoded once and then known.

    What is known is bounded in bytes and lives as long as the task that made it.  Texts of the
    first 256 characters without special strings, which normalising leaves as they are but for
    lowering, are cut by the tokenizer's pattern itself and their words given to its model.
    Whether that holds for a tokenizer is tried on samples first; all other texts, and those of
    tokenizers that fail, are cut at blanks and their pieces take the whole way.
    """

    SAMPLES = (
        "The WORDS of Größe, été and niño's 12³ co-op!? x_1 ½ª µm",
        "  two  blanks\n\nand\ttabs \xa0 end ",
        "it'S don't 'll'd ''s a.b,c;d {x} £5÷2×3 «oui» ÀÿÞß",
    )
    #: Bytes of pieces and ids, with what Python needs for an entry; longer pieces are not kept.
    MOST_BYTES, ENTRY_BYTES, LONG_CHARS = 64 << 20, 220, 200
    #: Pieces looked up at once, and pieces encoded in one string.
    SLICE_PIECES, TOGETHER = 1 << 17, 64

    def __init__(self, tokenizer, split: Callable[[str], list[str]]):
        self.tokenizer, self.split, self.held = tokenizer, split, 0
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = list(tokenizer.get_added_tokens_decoder().values())
        # pieces are encoded side by side with a special string between them, whose id tells where one ends
        plain = [t.content for t in added if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.between = plain[0] if plain else None
        self.starts = {t.content[:2] for t in added}
        self.lowers = "Lowercase" in repr(tokenizer.normalizer)
        self.words = Words(tokenizer, "H" if self.kind.itemsize == 2 else "I", self.MOST_BYTES)
        self.pattern = _PATTERNS.get(split)
        wholes = self._alone(list(self.SAMPLES))
        if self.pattern and any(self._by_words(t) != ids for t, ids in zip(self.SAMPLES, wholes, strict=True)):
            self.pattern = None

    def _by_words(self, text: str) -> bytes | None:
        """The ids of a text by the words of the pattern, if it is a text of that kind."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if any(s in text for s in self.starts):
            return None
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower() if self.lowers else text)))

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        if self.between is None:
            return self._alone(pieces)
        mark, size, out = self.tokenizer.token_to_id(self.between), self.kind.itemsize, []
        groups = [pieces[k : k + self.TOGETHER] for k in range(0, len(pieces), self.TOGETHER)]
        strings = [self.between.join(g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(ids == mark).tolist()
            if len(ends) != len(group) - 1:  # a piece holds the special string itself
                out += self._alone(group)
                continue
            packed, start = ids.tobytes(), 0
            for end in ends:
                out.append(packed[start : end * size])
                start = (end + 1) * size
            out.append(packed[start:])
        return out

    def _for(self, pieces: list[list[str]]) -> Callable[[str], bytes]:
        """The ids of any of ``pieces``; long ones are encoded for this once."""
        if self.held > self.MOST_BYTES:
            self.clear()
            self.held = 0
        new = set().union(*pieces).difference(self)
        long = [p for p in new if len(p) > self.LONG_CHARS]
        short = list(new.difference(long)) if long else list(new)
        found = [self._by_words(p) for p in short] if self.pattern else [None] * len(short)
        rest = iter(self._encoded([p for p, ids in zip(short, found, strict=True) if ids is None]))
        found = [next(rest) if ids is None else ids for ids in found]
        self.update(zip(short, found, strict=True))
        self.held += sum(map(len, short)) + sum(map(len, found)) + self.ENTRY_BYTES * len(short)
        if not long:
            return self.__getitem__
        once = dict(zip(long, self._alone(long), strict=True))
        return lambda p: once[p] if p in once else self[p]

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as bytes of ``kind``."""
        for text in texts:
            ids = self._by_words(text) if self.pattern else None
            if ids is None:
                ids = b"".join(self._in_pieces(self.split(text)))
            yield ids

    def _in_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), self.SLICE_PIECES):
            own = pieces[at : at + self.SLICE_PIECES]
            yield from map(self._for([own]), own)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, self.kind) for b in self.packed(texts)]

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.fromiter((len(b) // self.kind.itemsize for b in self.packed(texts)), np.int64, len(texts))

    def sizes(self, pieces: list[str]) -> np.ndarray:
        """Ids of each piece of one text."""
        known = self._for([pieces])
        return np.fromiter((len(known(p)) // self.kind.itemsize for p in pieces), np.int64, len(pieces))


def _blank_marks(pieces: Pieces, text: str, a: int, b: int) -> tuple[dict[int, int], int]:
    """Offsets in ``text[a:b]`` where a piece starts with the tokens before, and the number of all tokens."""
    parts = pieces.split(text[a:b])
    places = a + np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    before = np.concatenate([[0], np.cumsum(pieces.sizes(parts), dtype=np.int64)])
    return dict(zip(places[:-1].tolist(), before[:-1].tolist(), strict=True)), int(before[-1])


def _word_marks(pieces: Pieces, text: str, a: int, b: int) -> tuple[dict[int, int], int]:
    """The same for every word of the pattern, from the offsets that the library gives."""
    encoded = pieces.tokenizer.encode(text[a:b], add_special_tokens=False)
    found, last = {}, None
    for k, (word, offset) in enumerate(zip(encoded.word_ids, encoded.offsets, strict=True)):
        if word != last:
            found.setdefault(a + offset[0], k)
            last = word
    return found, len(encoded.ids)


def chunked_spans(pieces: Pieces, text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """``start, end, tokens`` of pieces of a huge text, each encoded within a chunk.

    Neighbouring chunks overlap.  They are spliced where both have a word of the pattern start,
    far enough from the left chunk's end for that start to be the whole text's too: the
    pattern's words look ahead one character, a special string cut in two is shorter than the
    margin, and nothing is looked back at, so from a common start on the right chunk is exact.
    Starts at blanks are tried first, then those of all words; without a common start the
    overlap doubles, and once it covers the left chunk, that chunk itself grows.
    """
    added = pieces.tokenizer.get_added_tokens_decoder().values()
    margin = 4 + max((len(t.content) for t in added), default=0)
    sync, b, before = 0, min(chunk, len(text)), 0
    marks = _blank_marks
    left, total = marks(pieces, text, sync, b)
    while b < len(text):
        width = overlap
        while True:
            c = max(sync, b - width)
            end = min(c + chunk + width, len(text))
            right, all_right = marks(pieces, text, c, end)
            # the last word before the margin may be cut by the chunk's end, its start is not
            common = [x for x in right if max(c, sync + 1) <= x <= b - margin and x in left]
            if common:
                x = max(common)
                yield sync, x, left[x] - before
                sync, b, left, total, before = x, end, right, all_right, right[x]
                break
            if marks is _blank_marks:
                marks = _word_marks
                left, total = marks(pieces, text, sync, b)
                before = 0
            elif c > sync:
                width *= 2
            else:
                b = min(b + chunk, len(text))
                left, total = marks(pieces, text, sync, b)
                before = 0
                width = overlap
                if b == len(text):
                    break
        marks = _blank_marks
    yield sync, b, total - before
