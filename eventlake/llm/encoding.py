"""Token ids of whole texts by the tokenizers library, piece by piece.

Both public vocabularies split a text before they merge. Texts are cut at white space, where neither merges across, a
batch at a time; pieces of the characters of `_LETTER` and printable ASCII are cut further into runs of letters, digits and
other characters, as both vocabularies' patterns part them. Each distinct piece, and each distinct run, is encoded once in
a worker and kept in tables of bounded size; the ids of a batch are gathered from them.

Encoded whole are pieces with an apostrophe (whose patterns have words of their own) or with other characters, texts with
the vocabulary's special strings, which the library finds in a text unless told not to, and texts in which white space
beyond ASCII touches other white space.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import caches, flat, hashed, lower, spans, steady, white

#: Pieces, and runs, kept by a worker.
KEPT = 300_000
#: Runs of letters encoded as one text.
TOGETHER = 500
_encoders: dict = {}
caches.append(_encoders.clear)

# kinds of bytes: 0 others, 1 letters, 2 digits, 3 white; bytes beyond ASCII are told by their neighbours
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


def _at(buf: np.ndarray, by: int) -> np.ndarray:
    """buf moved by so many places, zeros beyond."""
    out = np.zeros(len(buf), np.uint8)
    if by > 0:
        out[:-by] = buf[by:]
    else:
        out[-by:] = buf[:by]
    return out


def wide_white(buf: np.ndarray) -> np.ndarray:
    """First bytes of white space beyond ASCII in UTF-8."""
    out = np.zeros(len(buf), bool)
    lead = np.flatnonzero((buf == 0xC2) | (buf >= 0xE1) & (buf <= 0xE3))
    if len(lead):
        padded = np.concatenate([buf, np.zeros(2, np.uint8)])
        code = padded[lead].astype(np.int64) << 16 | padded[lead + 1].astype(np.int64) << 8 | padded[lead + 2]
        two, three = code >> 8, code
        hit = np.isin(two, (0xC285, 0xC2A0)) | np.isin(three, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)) | (three >= 0xE28080) & (three <= 0xE2808A)
        out[lead[hit]] = True
    return out


def pieces_of(buf: np.ndarray, off: np.ndarray, word_level: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the pieces, and how many each row has. Word level: runs without white space. Else a run goes with
    a single space before it, and of white space before a run the last character is a piece of its own, or that space."""
    n = len(off) - 1
    blank = white(buf)
    if word_level:
        start, end, row = spans(~blank, off)
        return buf[~blank], np.concatenate([[0], np.cumsum(end - start)]), np.bincount(row, minlength=n)
    first, last, row = spans(blank, off)
    before = last < off[row + 1]  # white space before a run of its row
    own = before & (buf[last - 1] != 32)
    mark = np.zeros(len(buf) + 1, bool)
    mark[off] = True
    mark[first] = True
    mark[last[before] - 1] = True
    mark[last[own]] = True
    mark[len(buf)] = False
    cut = np.flatnonzero(mark)
    return buf, np.append(cut, len(buf)), np.bincount(np.searchsorted(off, cut, side="right") - 1, minlength=n)


def runs_of(buf: np.ndarray, off: np.ndarray, word_level: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the runs of rows that can be parted, how many each has (0: none, it is encoded whole), and those rows."""
    kind = _KIND[buf]
    after_c3 = _at(buf, -1) == 0xC3
    letter = after_c3 & (buf >= 0x80) & (buf <= 0xBF) & (buf != 0x97) & (buf != 0xB7)
    kind[letter] = 1
    kind[(buf == 0xC3) & _at(letter.view(np.uint8), 1).astype(bool)] = 1
    odd = (kind == 0) & ((buf < 33) | (buf > 126) | (buf == 39)) | (kind == 3)
    starts = off[:-1][np.diff(off) > 0]
    if not word_level:  # the space before a run belongs to it
        lead = starts[buf[starts] == 32]
        lead = lead[lead + 1 < len(buf)]
        odd[lead] = False
        kind[lead] = kind[lead + 1]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    bad = np.bincount(row[odd], minlength=len(off) - 1) > 0
    if not word_level:
        bad |= (np.diff(off) == 1) & (buf[np.minimum(off[:-1], max(len(buf) - 1, 0))] == 32) if len(buf) else bad
    edge = np.ones(len(buf), bool)
    edge[1:] = kind[1:] != kind[:-1]
    if word_level:
        edge |= kind == 2  # each digit is a word
    edge[starts] = True
    edge &= ~bad[row]
    cut = np.flatnonzero(edge)
    size = np.zeros(len(off), np.int64)
    size[1:] = np.cumsum(np.where(bad, 0, np.diff(off)))
    inner = cut - off[row[cut]] + size[row[cut]]  # in the bytes of the rows that are not bad
    return np.append(inner, size[-1]), np.bincount(row[cut], minlength=len(off) - 1), bad


class _Table:
    """Strings and their ids, each end to end in arrays; found by a hash, then compared byte by byte."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hash
        self.parts = {"bytes": np.zeros(1 << 16, np.uint8), "ids": np.zeros(1 << 16, self.dtype)}
        self.used = {"bytes": 0, "ids": 0}
        self.starts = {k: np.zeros(1 << 14, np.int64) for k in self.parts}
        self.lengths = {k: np.zeros(1 << 14, np.int32) for k in self.parts}

    def _put(self, part: str, values: np.ndarray, length: np.ndarray) -> None:
        n, m, used = len(self.keys), len(length), self.used[part]
        while n + m > len(self.starts[part]):
            for held in (self.starts, self.lengths):
                held[part] = np.concatenate([held[part], np.zeros_like(held[part])])
        while used + len(values) > len(self.parts[part]):
            self.parts[part] = np.concatenate([self.parts[part], np.zeros_like(self.parts[part])])
        self.parts[part][used : used + len(values)] = values
        self.lengths[part][n : n + m] = length
        self.starts[part][n : n + m] = used + np.cumsum(length) - length
        self.used[part] = used + len(values)

    def find(self, buf: np.ndarray, off: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of each string its place, -1 where it isn't here."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        near = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at, size = self.slot[near], np.diff(off)
        same = (self.keys[near] == h) & (self.lengths["bytes"][at] == size)
        rows = np.flatnonzero(same)
        length = size[rows]
        nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        differ = self.parts["bytes"][np.repeat(self.starts["bytes"][at[rows]], length) + nth] != buf[np.repeat(off[rows], length) + nth]
        same[rows[np.bincount(np.repeat(np.arange(len(rows)), length)[differ], minlength=len(rows)) > 0]] = False
        return np.where(same, at, -1)

    def add(self, strings_: pa.Array, h: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        n, m = len(self.keys), len(h)
        buf, off = flat(strings_)
        self._put("bytes", buf, np.diff(off))
        self._put("ids", ids, length)
        at = np.arange(n, n + m)
        keys, slot = np.concatenate([self.keys, h]), np.concatenate([self.slot, at])
        order = np.argsort(keys, kind="stable")  # of strings that share a hash the first is found, the others are new each time
        self.keys, self.slot = keys[order], slot[order]
        return at

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.lengths["ids"][at].astype(np.int64)
        shift = self.starts["ids"][at] - (np.cumsum(length) - length)
        return self.parts["ids"][np.repeat(shift, length) + np.arange(int(length.sum()))], length


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next counts[0], counts[1] ... values of x."""
    total = np.concatenate([[0], np.cumsum(x)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


class Encoder:
    """ids(column): the ids of its texts end to end as `dtype`, and their offsets. word_level: white space has no ids and case
    none."""

    def __init__(self, path: str, dtype: str, word_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._dtype, self._word_level = dtype, word_level
        self._pieces, self._runs = _Table(dtype), _Table(dtype)
        vocabulary = self._tokenizer.get_vocab()
        # of each id: whether it ends a word (word level), or begins one with a space
        self._edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self._edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if word_level else t.startswith("Ġ"))]] = True
        self._break = -1 if word_level else self._one("\n")[0]

    def _one(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self._dtype)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, self._dtype)], [np.zeros(0, np.int64)]
        for one in self._encoded(texts, TOGETHER):
            ids.append(one)
            lengths.append(np.array([len(one)], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def _encoded(self, texts: list[str], at_once: int):
        """The ids of each text; the library's own objects are of few texts at a time."""
        for i in range(0, len(texts), at_once):
            for one in self._tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield np.array(one.ids, self._dtype)

    def _joined(self, runs: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """As _each, of runs of letters: many go in a text, parted by the ids at their edges or by line breaks."""
        groups = [runs[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]
        ids, lengths = [np.zeros(0, self._dtype)], [np.zeros(0, np.int64)]
        for group, made in zip(groups, self._encoded([between.join(g) for g in groups], 8), strict=True):
            if between == "\n":
                edges = np.concatenate([[-1], np.flatnonzero(made == self._break), [len(made)]])
                length, made = np.diff(edges) - 1, made[made != self._break]
            elif self._word_level:
                length = np.diff(np.concatenate([[-1], np.flatnonzero(self._edge[made])]))
            else:
                length = np.diff(np.append(np.flatnonzero(self._edge[made]), len(made)))
            if len(length) != len(group) or length.sum() != len(made):
                made, length = self._each(group)
            ids.append(made)
            lengths.append(length)
        return np.concatenate(ids), np.concatenate(lengths)

    def _codes(self, table: _Table, buf: np.ndarray, off: np.ndarray, learn) -> np.ndarray:
        """Of each string its place in the table."""
        coded = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        distinct, ends = flat(coded.dictionary)
        h = hashed(distinct, ends[:-1], ends[1:])
        at = table.find(distinct, ends, h)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = learn(coded.dictionary.take(pa.array(new)), h[new])
        return at[np.asarray(coded.indices)]

    def _learn_runs(self, new: pa.Array, h: np.ndarray) -> np.ndarray:
        runs = new.to_pylist()
        letters = np.array([r[-1].isalpha() for r in runs], bool)
        spaced = np.array([r[0] == " " for r in runs], bool) | self._word_level
        rows, made = [], []
        for some, make in ((letters & spaced, lambda x: self._joined(x, " " if self._word_level else "")), (letters & ~spaced, lambda x: self._joined(x, "\n")), (~letters, self._each)):
            rows.append(np.flatnonzero(some))
            made.append(make([runs[i] for i in rows[-1].tolist()]))
        order, at = np.concatenate(rows), np.zeros(len(runs), np.int64)
        at[order] = self._runs.add(new.take(pa.array(order)), h[order], *map(np.concatenate, zip(*made, strict=True)))
        return at

    def _learn(self, new: pa.Array, h: np.ndarray) -> np.ndarray:
        if len(self._runs.keys) > KEPT:
            self._runs.clear()
        buf, off = flat(new)
        edges, count, bad = runs_of(buf, off, self._word_level)
        row = np.repeat(bad, np.diff(off))
        ids, length = self._runs.gather(self._codes(self._runs, buf[~row], edges, self._learn_runs))
        plain, odd = np.flatnonzero(~bad), np.flatnonzero(bad)
        odd_ids, odd_length = self._each(new.take(pa.array(odd)).to_pylist())
        order, at = np.concatenate([plain, odd]), np.zeros(len(new), np.int64)
        at[order] = self._pieces.add(new.take(pa.array(order)), h[order], np.concatenate([ids, odd_ids]), np.concatenate([_sums(length, count[plain]), odd_length]))
        return at

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pieces.keys) > KEPT:
            self._pieces.clear()
        buf, off = flat(column)
        whole = self._whole(column, buf, off)
        if whole.any():
            return self._mixed(column, whole)
        data, edges, count = pieces_of(lower(buf) if self._word_level else buf, off, self._word_level)
        if not len(edges) > 1:
            return np.zeros(0, self._dtype), np.zeros(len(off), np.int64)
        ids, length = self._pieces.gather(self._codes(self._pieces, data, edges, self._learn))
        return ids, np.concatenate([[0], np.cumsum(_sums(length, count))])

    def _whole(self, column: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows to be encoded whole."""
        out = np.zeros(len(column), bool)
        for s in self._special:
            out |= np.asarray(pc.match_substring(column, s, ignore_case=self._word_level).fill_null(False).to_numpy(zero_copy_only=False), bool)
        if not self._word_level:
            wide = wide_white(buf)
            at = np.flatnonzero(wide)
            if len(at):
                end = at + np.where(buf[at] == 0xC2, 2, 3)
                any_white = white(buf) | wide
                last = np.zeros(len(buf) + 1, bool)
                last[np.flatnonzero(white(buf)) + 1] = True
                last[end] = True  # a place that follows white space
                touches = last[at] | np.append(any_white, False)[end]
                out[np.searchsorted(off, at[touches], side="right") - 1] = True
        return out

    def _mixed(self, column: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        odd, odd_length = self._each([texts[i] for i in np.flatnonzero(whole).tolist()])
        ids, off = self.ids(column.filter(pa.array(~whole))) if not whole.all() else (np.zeros(0, self._dtype), np.zeros(1, np.int64))
        length = np.zeros(len(column), np.int64)
        length[whole], length[~whole] = odd_length, np.diff(off)
        out = np.zeros(int(length.sum()), self._dtype)
        of_whole = np.repeat(whole, length)
        out[of_whole], out[~of_whole] = odd, ids
        return out, np.concatenate([[0], np.cumsum(length)])


def encoder(name: str, dtype: str, word_level: bool) -> Encoder:
    """One for each vocabulary in a worker. name: of public_tokenizers, or a path."""
    key = (name, dtype, word_level)
    if key not in _encoders:
        steady()
        if os.path.isabs(name):
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[key] = Encoder(path, dtype, word_level)
    return _encoders[key]


def with_end(ids: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text."""
    return np.insert(ids, off[1:], end), off + np.arange(len(off))
