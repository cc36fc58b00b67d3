"""Token ids with the tokenizers library: every distinct piece of a batch of texts is encoded once, and pieces in common use are remembered."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A word with the space before it, or white space: the byte-level pattern cuts at each of these places too, whatever stands around them.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python takes the last four controls for white space and the tokenizers do not; a zero marks a key below. Texts with them, or with the marks of special tokens, are encoded whole.
_WHOLE = r"[\x00\x1c-\x1f]|<\|"
#: White space by which a byte-level text is cut by _CHUNK rather than at its single spaces and line feeds.
_ODD = r"  | \n|\n\n\n|\n\n |[\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]\z"
#: Unknown pieces are encoded so many at once; texts are handled so many bytes at once.
_JOINED, _GROUPS, _BYTES = 200, 10, 4 << 20
_MARKS = (".", ",")
#: A normalizer that leaves lower-case ASCII words between single spaces as they are.
_IDLE = 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])'
#: What an entry of the cache takes beside its key and its ids; longer keys aren't kept.
_ENTRY, _LONG = 200, 256


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(pool)) < 2**31 else np.int64
    return pool[np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(n, dtype=kind)]


def _as_arrow(texts) -> pa.Array:
    return pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())


class Encoder:
    """encode(texts) gives the ids of each text as an array, the same as the tokenizer's own over the whole text; a null text is empty.

    The ids of a piece don't depend on its neighbours. A key of a byte-level tokenizer stands for a space and the key; one that begins with a line feed stands for
    itself; one that begins with a zero stands for what follows. Keys that come twice in a batch are kept, in `most` bytes. Unknown keys are encoded joined, and
    their ids told apart by the bytes that each id stands for; where these don't add up, each is encoded alone.
    """

    def __init__(self, path: str, most: int = 40 << 20, batch: int = _BYTES) -> None:
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.batch = most, batch
        self.words = "Lowercase" in str(self.tokenizer.normalizer)
        # of words in ASCII, which are in lower case already, the normalizer would only take its time
        self.plain = self.tokenizer
        if str(self.tokenizer.normalizer) == _IDLE:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = Sequence([])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>") if self.words else token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.pool, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts) -> Iterator[np.ndarray]:
        """texts: a list of strings or an Arrow array of them."""
        column = _as_arrow(texts)
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.batch)))
            yield from self._encode(column.slice(at, to - at))
            pa.default_memory_pool().release_unused()
            at = to

    def _keys(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """The keys of all texts; where each text's begin and how many they are; the ids of texts that are encoded whole."""
        whole = pc.match_substring_regex(column, _WHOLE)
        n = len(column)
        begin, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if self.words:
            odd = pa.array(np.zeros(n, bool))
            cut = pc.ascii_split_whitespace(pc.ascii_lower(column))
        else:
            odd = pc.and_not(pc.match_substring_regex(column, _ODD), whole)
            line, none = pa.scalar("\n", column.type), pa.scalar("", column.type)
            cut = pc.split_pattern(pc.binary_join_element_wise(line, pc.replace_substring(column, "\n", " \n"), none), " ")
        plain = np.flatnonzero(pc.invert(pc.or_(whole, odd)).to_numpy(zero_copy_only=False))
        if len(plain) < n:
            cut = cut.take(pa.array(plain))
        offsets = cut.offsets.to_numpy()
        keys = cut.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        begin[plain], count[plain] = offsets[:-1] - offsets[0], np.diff(offsets)
        extra: list[str] = []
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            chunks = [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else "\0" + c for c in _CHUNK.findall(column[i].as_py())]
            begin[i], count[i] = len(keys) + len(extra), len(chunks)
            extra += chunks
        if extra:
            keys = pa.concat_arrays([keys, pa.array(extra, keys.type)])
        return keys, begin, count, {i: self._alone([column[i].as_py()])[0] for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()}

    def _encode(self, column: pa.Array) -> list[np.ndarray]:
        keys, begin, count, alone = self._keys(column)
        coded = keys.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        del keys, coded
        entry = np.array([-1 if e is None else e for e in map(self.known.get, names)], np.int64)
        lacking = np.flatnonzero(entry < 0)
        new = [names[i] for i in lacking.tolist()]
        ids, lengths = self._learn(new) if new else (np.empty(0, np.uint32), np.empty(0, np.int64))
        starts, own = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        held = entry >= 0
        starts[held], own[held] = self.starts[entry[held]], self.lengths[entry[held]]
        starts[lacking], own[lacking] = len(self.pool) + np.cumsum(lengths) - lengths, lengths
        pool = np.concatenate([self.pool, ids])
        piece_length = own[codes]
        flat = _gather(pool, starts[codes], piece_length)
        ends = np.concatenate([[0], np.cumsum(piece_length)])
        skip = np.zeros(len(begin), np.int64)
        if not self.words:
            first = codes[np.minimum(begin, len(codes) - 1)] if len(codes) else begin
            # the line feed that isn't in the text
            line = np.array([name[:1] == "\n" for name in names], bool)
            skip = ((count > 0) & line[first]).astype(np.int64) if len(codes) else skip
        self._keep(names, codes, lacking, starts, own, pool)
        spans = zip((ends[begin] + skip).tolist(), ends[begin + count].tolist())
        return [alone[i] if i in alone else flat[s:e] for i, (s, e) in enumerate(spans)]

    def _keep(self, names: list[str], codes: np.ndarray, lacking: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> None:
        """Remembers the new keys that came twice. Beyond `most` bytes all are forgotten but those of this batch that came twice."""
        twice = np.bincount(codes, minlength=len(names)) > 1
        chosen = lacking[twice[lacking]]
        size = lambda at: sum(len(names[i]) + _ENTRY for i in at.tolist()) + 4 * int(lengths[at].sum())
        if self.held + size(chosen) > self.most:
            chosen = np.flatnonzero(twice)
            self._forget()
        chosen = np.array([i for i in chosen.tolist() if len(names[i]) <= _LONG], np.int64)
        if self.held + size(chosen) > self.most:
            return
        self.held += size(chosen)
        base, at = len(self.starts), len(self.pool)
        self.pool = np.concatenate([self.pool, _gather(pool, starts[chosen], lengths[chosen])])
        self.starts = np.concatenate([self.starts, at + np.cumsum(lengths[chosen]) - lengths[chosen]])
        self.lengths = np.concatenate([self.lengths, lengths[chosen]])
        self.known.update((names[i], base + k) for k, i in enumerate(chosen.tolist()))

    def _alone(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _sizes(self, parts: list[str]) -> np.ndarray:
        """Bytes of each part after the tokenizer's normalizer."""
        if self.words:
            return np.array([len(p) if p.isascii() else len(unicodedata.normalize("NFC", p).lower().encode()) for p in parts], np.int64)
        return np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts))

    def _joined(self, keys: list[str], shown: Callable[[str], str], between: str, plain: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number in each key) of groups of keys, which may stand side by side as they are shown with `between`, which the tokenizer drops."""
        out = []
        # a few groups at a time, since the library's results take many times the ids
        for first in range(0, len(keys), _GROUPS * _JOINED):
            some = list(map(shown, keys[first : first + _GROUPS * _JOINED]))
            size = self._sizes(some)
            groups = [some[i : i + _JOINED] for i in range(0, len(some), _JOINED)]
            texts = [between.join(g) for g in groups]
            tokenizer = self.plain if plain else self.tokenizer
            for k, e in enumerate(tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.cumsum(self.width[ids])
                stops = np.cumsum(size[k * _JOINED : (k + 1) * _JOINED])
                at = np.searchsorted(ends, stops)
                if not len(ends) or ends[-1] != stops[-1] or (ends[np.minimum(at, len(ends) - 1)] != stops).any():
                    each = self._alone(groups[k])
                    out.append((np.concatenate(each), np.array(list(map(len, each)), np.int64)))
                else:
                    out.append((ids, np.diff(at + 1, prepend=0)))
        return out

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of unknown keys, one after the other, and their numbers. A key with a full stop or comma after a letter is its stem and the mark, since no token spans the two."""
        stem = [w[:-1] if w[-1:] in _MARKS and w[-2:-1].isalpha() else w for w in new]
        ending = [None if s is w else w[-1] for w, s in zip(new, stem)]
        skip = np.zeros((len(new), 2), np.int64)
        if self.words:
            # white space at an end of a text leaves an empty key, which has no ids
            # those in ASCII come first, for the tokenizer without a normalizer
            shown = dict.fromkeys([*filter(str.isascii, stem), *stem])
            rest = [shown.pop("")] if "" in shown else []
            rest = [""] * len(rest)
            words = list(shown)
            n = sum(map(str.isascii, words))
            pieces = [*self._joined(words[:n], str, " ", plain=True), *self._joined(words[n:], str, " "), *[(np.empty(0, "<u4"), np.zeros(1, np.int64)) for _ in rest]]
        else:
            odd = [i for i, s in enumerate(stem) if s[:1] == "\0" and not s[1].isspace()]
            for i in odd:
                # a bare word is what follows a line feed, which is one token
                stem[i], skip[i, 0] = "\n" + stem[i][1:], 1
            shown = dict.fromkeys(stem)
            rest = [w for w in shown if w in ("", "\n") or w[0] == "\0"]
            for w in rest:
                del shown[w]
            pieces = self._joined(list(shown), lambda w: w if w[0] == "\n" else " " + w, "")
            pieces += [(e, np.array([len(e)])) for e in self._alone([w[1:] if w[:1] == "\0" else w or " " for w in rest])]
        shown.update(dict.fromkeys(rest))
        for i, w in enumerate(shown):
            shown[w] = i
        place = shown
        marks = self._alone(list(_MARKS))
        ids = np.concatenate([np.empty(0, "<u4"), *[p[0] for p in pieces], *marks])
        length = np.concatenate([np.empty(0, np.int64), *[p[1] for p in pieces], [len(m) for m in marks], [0]])
        start = np.cumsum(length) - length
        second = dict(zip(_MARKS, range(len(place), len(place) + len(marks))))
        last = len(place) + len(marks)
        at = np.empty((len(new), 2), np.int64)
        at[:, 0] = list(map(place.__getitem__, stem))
        at[:, 1] = [last if s is None else second[s] for s in ending]
        run = length[at] - skip
        return _gather(ids, (start[at] + skip).ravel(), run.ravel()), run.sum(axis=1)


_MADE: dict[str, Encoder] = {}


def encoder(path: str, batch: int = _BYTES) -> Encoder:
    """One for each worker process and tokenizer."""
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    _MADE[path].batch = batch
    return _MADE[path]


def tokenizer_path(name_or_path: str) -> str:
    """A file's path as it is, or the path of one of the public tokenizers by name."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
