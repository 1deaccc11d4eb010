"""Whole-text tokenization with the ``tokenizers`` library, each distinct part encoded once.

Texts are cut at places where the tokenizer itself always begins a new piece, so the
ids of the parts, joined, are the ids of the text:

* before a lone space, and before and after a lone line break, between characters that are no white space;
* between a letter or digit and one of ``MARKS``, and between such a mark and an ASCII letter or digit.

Elsewhere, and in texts that hold a special token's string, nothing is cut, so a part may be long.
Cuts are new offsets into the same buffer of text; parts are counted, looked up and
expanded column-wise, and only parts that are not remembered reach the library.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that, right after a letter or digit, always begin a piece of their own (no apostrophe, which contractions have).
MARKS = b".,;:!?%&$#*"
LONGEST_KEPT = 64

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_OPEN: dict[str, "PartEncoder"] = {}


def encoder(path: str) -> "PartEncoder":
    """The worker's encoder for a vocabulary file; it outlives the task."""
    if path not in _OPEN:
        _OPEN[path] = PartEncoder(path)
    return _OPEN[path]


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """``out[i] = x[i - by]``, False where there is none."""
    out = np.zeros_like(x)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of a white-space character, ASCII or not."""
    white = _WHITE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    lead = lead[lead + 2 < len(data)]
    x, y, z = data[lead].astype(np.int32), data[lead + 1].astype(np.int32), data[lead + 2].astype(np.int32)
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    code = ((x & 15) << 12) | ((y & 63) << 6) | (z & 63)
    three = (x > 0xC2) & (((code >= 0x2000) & (code <= 0x200A)) | np.isin(code, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    for k, kind in ((0, two | three), (1, two | three), (2, three)):
        white[lead[kind] + k] = True
    if len(data) > 1 and data[-2] == 0xC2 and data[-1] in (0x85, 0xA0):
        white[-2:] = True
    return white


def cuts_of(data: np.ndarray) -> np.ndarray:
    """At which bytes a new part may begin."""
    if len(data) < 2:
        return np.zeros(len(data), bool)
    white = white_space(data)
    inner = ~(_shifted(white, 1) | _shifted(white, -1))
    line = inner & (data == 10)
    cuts = inner & (data == 32)
    cuts |= line
    cuts |= _shifted(line, 1)
    mark, plain = _MARK[data], _ALNUM[data]
    latin = _shifted(data == 0xC3, 1) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)  # letters of U+00C0 to U+00FF
    cuts |= mark & _shifted(plain | latin, 1)
    cuts |= plain & _shifted(mark, 1)
    return cuts


class PartEncoder:
    """``remember`` bounds how many parts are kept between calls; beyond it the half that is used less is dropped."""

    def __init__(self, path: str, remember: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.mode = self._mode(made)
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.remember = remember
        self.known = pa.array([], pa.string())
        self.flat, self.length, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _mode(made: dict) -> str:
        """space: byte-level BPE whose words carry their leading space; word: white space only separates; whole: neither is certain."""
        before, pre = made.get("normalizer"), made.get("pre_tokenizer") or {}
        if before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "space"
        parts = pre.get("pretokenizers") or []
        if parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and "[^\\s" in parts[0].get("pattern", {}).get("Regex", ""):
            if all(x.get("type") in ("NFC", "Lowercase", "Replace") for x in (before or {}).get("normalizers", [])):
                return "word"
        return "whole"

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), 4096):
            ids = [e.ids for e in self.tok.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(flats), np.concatenate(lengths)

    def _drop_half(self) -> None:
        keep = np.sort(np.argpartition(-self.used, self.remember // 2)[: self.remember // 2])
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(self.length))), self.flat)
        self.flat = lists.take(pa.array(keep)).flatten().to_numpy()
        self.known, self.length, self.used = self.known.take(pa.array(keep)), self.length[keep], self.used[keep] // 2

    def _lists(self, parts: pa.Array, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after another, and their numbers."""
        at = pc.index_in(parts, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        flat, length = self._raw(parts.filter(pa.array(new)).to_pylist())
        base = len(self.known)
        spots = at.fill_null(0).to_numpy().astype(np.int64)
        spots[new] = base + np.arange(int(new.sum()))
        lengths = np.concatenate((self.length, length))
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))), np.concatenate((self.flat, flat)))
        self.used[spots[~new]] += uses[~new]
        # What is worth remembering goes to the end of the store.
        short = pc.less_equal(pc.binary_length(parts), LONGEST_KEPT).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(new & short)
        self.known = pa.concat_arrays([self.known, parts.take(pa.array(keep))])
        own = lists.take(pa.array(spots[keep])).flatten().to_numpy(zero_copy_only=False)
        self.flat = np.concatenate((self.flat, own))
        self.length = np.concatenate((self.length, lengths[spots[keep]]))
        self.used = np.concatenate((self.used, uses[keep]))
        out = lists.take(pa.array(spots)).flatten().to_numpy(zero_copy_only=False), lengths[spots]
        if len(self.known) > self.remember:
            self._drop_half()
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (without nulls) in order (uint32), and each text's number of ids; ``end_id`` is appended to every text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.mode == "whole":
            flat, counts = self._raw(texts.to_pylist())
            return (flat, counts) if end_id is None else (np.insert(flat, np.cumsum(counts), end_id), counts + 1)
        _, offsets, body = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(body or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        raw, begin = data, np.append(cuts_of(data), False)
        if self.mode == "word":
            data = _LOWER[raw]  # as the normalizer does, so that fewer parts are distinct
        for token in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)).tolist():
                begin[ends[k] : ends[k + 1]] = False
                if self.mode == "word":
                    data[ends[k] : ends[k + 1]] = raw[ends[k] : ends[k + 1]]
        begin[ends] = True
        at = np.flatnonzero(begin).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        stops = np.searchsorted(at, ends)
        flat, lengths = self._lists(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)))
        if end_id is not None:
            codes = np.insert(codes, stops[1:], len(lengths))
            flat, lengths = np.append(flat, np.uint32(end_id)), np.append(lengths, 1)
            stops = stops + np.arange(len(stops))
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))), flat)
        upto = np.concatenate(([0], np.cumsum(lengths[codes])))[stops]
        return lists.take(pa.array(codes)).flatten().to_numpy(zero_copy_only=False), np.diff(upto)
