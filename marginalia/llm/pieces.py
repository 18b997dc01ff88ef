"""Encoding many texts with a tokenizer file by encoding each distinct piece once.

Texts are cut where the tokenizer itself always cuts, so the ids of a text are the ids of its pieces in
order. Unseen pieces of a batch are encoded together, in batches balanced by bytes; a long piece is cut again
where letters, digits and signs meet. Frequent pieces are remembered between batches, up to a bound of bytes.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of up to so many characters, all Latin letters, digits, signs, spaces or line ends, are cut into words here; all others go to the library whole.
LONG_PIECE = 256
BATCH_BYTES = 1 << 16
#: A piece the library is given is cut at the first safe place after so many characters; longer ones are not remembered.
CUT, REMEMBERED = 1024, 64
#: Bytes that remembered pieces may take in a worker, as estimated; ``ENTRY`` is an entry's own.
HELD_BYTES, ENTRY = 96 << 20, 200
#: Byte 0 as byte-level vocabularies spell it. No simple piece holds it, so it can stand between words.
MARK = " \u0100 "
_SPACE_CUT = re.compile(r"(?= \S)")
#: Signs that often end a word.
_ENDS = frozenset(",.;:?!")
_PLAIN = re.compile(f"[\n !-~\xa1-\xac\xae-\u024f]{{0,{LONG_PIECE}}}\\Z").match
#: Between a letter or digit and another kind of character every pre-tokenizer here cuts (marks may join a letter); of characters
#: whose kind no version of Unicode changes.
_OLD, _SIGNS = r"[\x00-\u9fff\uac00-\ud7a3]", r"[!-~\u2010-\u205e\u3001-\u303f\uff01-\uff5e]"
_SAFE = regex.compile(rf"(?V1)(?<=[\p{{L}}&&{_OLD}])(?=[{_SIGNS}--\p{{L}}--\p{{M}}])|(?<=[\p{{N}}&&{_OLD}])(?=[{_SIGNS}--\p{{N}}--\p{{M}}])")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write byte b as chr(b) if that is printable, else as the next unused character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Memo(dict):
    """Piece to slot; an unseen piece gets the next slot and is queued."""

    def __init__(self):
        super().__init__()
        self.queue: list = []
        self.next = 0

    def __missing__(self, piece):
        slot = self.next
        self[piece] = slot
        self.next = slot + 1
        self.queue.append(piece)
        return slot


class _UnsafeCut(Exception):
    pass


class _SpacedMemo(_Memo):
    """A piece that starts with white space would mean a cut inside a run of it."""

    def __missing__(self, piece):
        if type(piece) is str and (not piece or piece[0].isspace()):
            raise _UnsafeCut
        return super().__missing__(piece)


class PieceEncoder:
    """Ids of texts as ``tokenizers`` gives them for ``path``, without added special tokens.

    ``style`` is found from the file: ``words`` (white space dropped, lower-cased words), ``spaced``
    (byte-level, a space belongs to the word after it) or ``whole`` (no cut is known to be safe; texts are
    encoded whole). ``limit`` and ``held_bytes`` bound the remembered pieces; beyond either the less used half and all
    long ones are forgotten. A batch of texts adds at most some tens of times its bytes before that.
    """

    def __init__(self, path: str, limit: int = 300_000, held_bytes: int = HELD_BYTES):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.special = [x["content"] for x in spec.get("added_tokens") or ()]
        self.style = self._style(spec)
        self.model = Tokenizer(self.library.model)  # words in, ids out: no normaliser, cut at white space
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        mark = self.model.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            self.style = "whole"
        self.mark = mark[0]
        self.limit, self.held_bytes, self.serial = limit, held_bytes, itertools.count()
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._forget()

    @staticmethod
    def _style(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        plain = all(not (x["lstrip"] or x["rstrip"] or x["normalized"]) or x["special"] and not (x["lstrip"] or x["rstrip"]) for x in spec.get("added_tokens") or ())
        if spec["model"].get("type") != "BPE" or spec["model"].get("unk_token") or not plain:
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm == "null":
            return "spaced"
        kinds = re.findall(r'"type": "(\w+)"', norm)
        if kinds == ["Sequence", "NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", ())] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}:
            return "words"
        return "whole"

    def _forget(self) -> None:
        self.memo = _SpacedMemo() if self.style == "spaced" else _Memo()
        self.words = _Memo()
        self.used = np.zeros(0, np.int64)  # of pieces
        self.piece_words = _Ragged(np.int32)
        self.word_ids = _Ragged(np.uint32)
        self.keys = 0  # bytes of pieces and words

    def held(self) -> int:
        """Bytes of what is remembered."""
        return self.keys + ENTRY * (len(self.memo) + len(self.words)) + self.piece_words.flat.nbytes + self.word_ids.flat.nbytes

    def _whole(self, text: str) -> list[str]:
        """A text for the library in parts that it would cut itself; special strings stay whole."""
        if len(text) <= CUT or self.style == "whole":
            return [text]
        out = []
        for part in self.parts.split(text) if self.parts else [text]:
            at = 0
            while len(part) - at > CUT and (m := _SAFE.search(part, at + CUT)):
                out.append(part[at : m.start()])
                at = m.start()
            out.append(part[at:])
        return [x for x in out if x]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the bounds of each text in them (one more than texts)."""
        slots, bounds = self._slots(texts)
        words, ends = self.piece_words.take(slots)
        ids, word_ends = self.word_ids.take(words)
        return ids, word_ends[ends[bounds]]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        slots, bounds = self._slots(texts)
        words, ends = self.piece_words.take(slots)
        return np.diff(np.concatenate([[0], np.cumsum(self.word_ids.sizes()[words])])[ends[bounds]])

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.limit or self.held() > self.held_bytes:
            self._shrink()
        get, all_slots, bounds = self.memo.__getitem__, [], [0]
        for text in texts:
            all_slots += self._cut(text, get)
            bounds.append(len(all_slots))
        self._learn()
        slots = np.array(all_slots, np.int64)
        used = np.bincount(slots, minlength=self.memo.next)
        used[: len(self.used)] += self.used
        self.used = used
        return slots, np.array(bounds)

    def _cut(self, text: str, get) -> list[int]:
        if not text:
            return []
        if self.style == "words":
            try:
                return list(map(get, text.lower().encode("latin-1").split()))
            except UnicodeEncodeError:
                return list(map(get, re.split("[ \t\n\r]+", text)))
        if self.style == "spaced":
            first, *rest = text.split(" ")
            try:
                return [get(first.encode()), *map(get, rest)] if first else list(map(get, rest))
            except _UnsafeCut:
                first, *rest = _SPACE_CUT.split(text)
                return [get(first.encode()), *(get(x[1:]) for x in rest)] if first else [get(x[1:]) for x in rest]
        return [get(text)]

    def _text(self, piece: str | bytes) -> str:
        if self.style == "words":
            return piece.decode("latin-1") if type(piece) is bytes else piece
        if self.style == "spaced":
            return piece.decode() if type(piece) is bytes else " " + piece
        return piece

    def _learn(self) -> None:
        """Encode the queued pieces: those of simple characters word by word, any other by the library whole."""
        if not self.memo.queue:
            return
        queue, self.memo.queue = self.memo.queue, []
        cut = {"words": _WORDS, "spaced": _SPACED, "whole": None}[self.style]
        lower, get, flat, sizes, whole = self.style == "words", self.words.__getitem__, [], [], []
        size = 0
        for piece in queue:
            size += len(piece) if type(piece) is bytes else 2 * len(piece)
            if lower and type(piece) is bytes and len(piece) <= LONG_PIECE:
                text = piece.decode("latin-1")  # lower-cased already
                if text.isalpha():
                    flat.append(get(text))
                    sizes.append(1)
                    continue
                if text[-1] in _ENDS and text[:-1].isalpha():
                    flat += (get(text[:-1]), get(text[-1]))
                    sizes.append(2)
                    continue
            text = self._text(piece)
            if cut and _PLAIN(text) and not ("<" in text and any(x in text for x in self.special)):
                found = list(map(get, cut.findall(text.lower() if lower else text)))
            else:
                parts = self._whole(text)
                whole += parts
                found = [get(("whole", next(self.serial))) for _ in parts]
            flat += found
            sizes.append(len(found))
        self.keys += size
        self.piece_words.append(flat, sizes)
        queue, self.words.queue = self.words.queue, []
        new = [w for w in queue if type(w) is str]
        spelled = [w if w.isascii() and w.isalpha() else w.translate(_LETTERS) if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in new]
        found, counts = [], []
        for group in _balanced(spelled, BATCH_BYTES):
            ids = np.array(self.model.encode_batch_fast([MARK.join(spelled[group])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.append(np.flatnonzero(ids == self.mark), len(ids))
            found.append(np.delete(ids, at[:-1]))
            counts.append(np.diff(at, prepend=-1) - 1)
        done = [np.array(x.ids, np.uint32) for group in _balanced(whole, BATCH_BYTES) for x in self.library.encode_batch_fast(whole[group], add_special_tokens=False)]
        if not done:
            self.word_ids.append(np.concatenate(found) if found else [], np.concatenate(counts) if counts else [])
            return
        # slots of words were given in the order of the queue, where whole pieces and words are mixed
        is_word, lengths = np.array([type(w) is str for w in queue]), np.array([len(x) for x in done])
        ids, counts = np.concatenate([*found, *done]), np.concatenate([*counts, lengths])
        rows = np.empty(len(queue), np.int64)
        rows[is_word], rows[~is_word] = np.arange(len(new)), np.arange(len(new), len(queue))
        n = counts[rows]
        start, ends = (np.cumsum(counts) - counts)[rows], np.cumsum(n)
        self.word_ids.append(ids[np.arange(len(ids)) + np.repeat(start - (ends - n), n)], n)

    def _shrink(self) -> None:
        """Keep the more used half of the pieces, and their words; no long ones."""
        pieces, words, used, piece_words, word_ids = list(self.memo), list(self.words), self.used, self.piece_words, self.word_ids
        keep = np.flatnonzero(used > np.partition(used, len(used) // 2)[len(used) // 2])
        keep = keep[[len(pieces[i]) <= REMEMBERED for i in keep.tolist()]] if len(keep) else keep
        self._forget()
        flat, ends = piece_words.take(keep)
        kept, flat = np.unique(flat, return_inverse=True)
        for i in keep.tolist():
            self.memo[pieces[i]]
        for i in kept.tolist():
            self.words[words[i]]
        self.keys = sum(2 * len(x) for x in self.memo)
        self.memo.queue, self.words.queue = [], []
        self.piece_words.append(flat, np.diff(ends))
        ids, ends = word_ids.take(kept)
        self.word_ids.append(ids, np.diff(ends))


class _Ragged:
    """Rows of numbers of any length, end to end in one array that doubles as it fills."""

    def __init__(self, kind):
        self.flat, self.filled = np.zeros(1 << 12, kind), 0
        self.ends, self.rows = np.zeros(1 << 10, np.int64), 0

    def append(self, flat, sizes) -> None:
        for name, filled, more in (("flat", self.filled, len(flat)), ("ends", self.rows + 1, len(sizes))):
            if filled + more > len(x := getattr(self, name)):
                setattr(self, name, np.concatenate([x, np.zeros(max(more, len(x)), x.dtype)]))
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.ends[self.rows + 1 : self.rows + 1 + len(sizes)] = self.filled + np.cumsum(sizes)
        self.filled, self.rows = self.filled + len(flat), self.rows + len(sizes)

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends[: self.rows + 1])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.ends[rows]
        n = self.ends[rows + 1] - start
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)], ends


def _balanced(parts: list[str], limit: int):
    """Runs of parts of about ``limit`` characters each, as slices."""
    a = total = 0
    for i, x in enumerate(parts):
        if total and total + len(x) > limit:
            yield slice(a, i)
            a, total = i, 0
        total += len(x) + 1
    if parts:
        yield slice(a, len(parts))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file; at most one file is kept."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
