"""One strict notion of JSON for the whole engine, worked out on the Arrow buffer of a batch of texts.

A batch is one byte buffer with offsets. Quotes, brackets, commas, colons and runs of other characters are found in the
whole buffer at once; whether a text is JSON follows from which token may follow which (a table), from the kind of bracket
that each comma and bracket stands in (a search per level), from one pattern for numbers and names, and from the characters
after backslashes. There is no limit of depth; repeated keys are allowed; NaN, single quotes and what follows the value
aren't. A text that is no JSON leaves no tokens and doesn't disturb its neighbours.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPEN, CLOSE, COMMA, COLON = 1, 2, 3, 4
#: Levels that are worked through one after the other; texts that nest deeper are walked token by token.
DEEP = 256


def _flags(characters: bytes, value=True, of=bool) -> np.ndarray:
    table = np.zeros(256, of)
    table[list(characters)] = value
    return table


KIND = _flags(b"{[", OPEN, np.uint8) + _flags(b"}]", CLOSE, np.uint8) + _flags(b",", COMMA, np.uint8) + _flags(b":", COLON, np.uint8)
BLANK = _flags(b" \t\n\r")
_ESCAPES, _HEX = _flags(b'"\\/bfnrtu'), _flags(b"0123456789abcdefABCDEF")
#: What an escaped character stands for.
_MEANT = np.arange(256, dtype=np.uint8)
_MEANT[list(b"bfnrt")] = list(b"\b\f\n\r\t")
_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
#: Tokens, and after which of them which may come; a string is a key after { and after a comma of an object.
_CODES = {c: i for i, c in enumerate("{}[],:SN")}
_CODE = np.zeros(256, np.int8)
for _c in "{}[],:":
    _CODE[ord(_c)] = _CODES[_c]
_AFTER = ["{:S}", "[:{[SN]", "object comma:S", "array comma:{[SN", "colon:{[SN", "key::", "value:,}]"]
_ALLOWED = np.zeros((len(_AFTER), len(_CODES)), bool)
for _i, _rule in enumerate(_AFTER):
    _ALLOWED[_i, [_CODES[_c] for _c in _rule.split(":", 1)[1]]] = True
_CLASS = np.array([0, 6, 1, 6, 2, 4, 6, 6])  # by code; commas and keys are told apart by where they stand
_STARTS = np.isin(np.arange(len(_CODES)), [_CODES[c] for c in "{[SN"])


def substrings(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: bytes = b"") -> pa.Array:
    """Strings data[start:end], each behind `prefix`, gathered without a loop."""
    if not len(start):
        return pa.array([], pa.large_string())
    size, k = (end - start).astype(np.int64), len(prefix)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size + k, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    for i in range(k):
        out[offsets[:-1] + i] = prefix[i]
    before = np.cumsum(size) - size
    step = np.arange(before[-1] + size[-1])
    out[np.repeat(offsets[:-1] + k - before, size) + step] = data[np.repeat(start.astype(np.int64) - before, size) + step]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(out))


def _runs(at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of neighbouring positions within a text, as places in `at`."""
    first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
    return first, np.diff(np.append(first, len(at)))


class Tape:
    """Structure of a batch of texts. valid: which are JSON. Of those: marks `at` with kind and depth behind them, strings from
    `first` to `last`, and containers in order of their opening, with level, kind, and by level; `deep`: the rows of valid
    texts that nest beyond DEEP levels, which have no marks here."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
        self.ends = ends = offsets[1:] - offsets[0]
        self.starts = starts = offsets[:-1] - offsets[0]
        bad = np.zeros(len(ends), bool)
        quote = data == 0x22
        self.escaped = escaped = np.empty(0, np.int64)
        if len(slash := np.flatnonzero(data == 0x5C)):
            row = self.row(slash)
            run, length = _runs(slash, row)
            odd = length % 2 == 1
            run, after = run[odd], (slash[run] + length)[odd]
            over = after >= ends[row[run]]
            bad[row[run][over]] = True
            self.escaped = escaped = after[~over]
            quote[escaped] = False
        marks = np.flatnonzero(quote)
        so_far = np.searchsorted(marks, ends)
        own = np.diff(so_far, prepend=0)
        inside = np.bitwise_xor.accumulate(quote.view(np.uint8))
        if (own % 2).any():  # a text with an open string doesn't reach the next one
            bad |= own % 2 == 1
            inside = inside ^ np.repeat(((so_far - own) % 2).astype(np.uint8), ends - starts)
        outside = inside == 0
        at = np.flatnonzero((KIND[data] > 0) & outside)
        kind, row = KIND[data[at]], self.row(at)
        height = np.concatenate(([0], np.cumsum((kind == OPEN).astype(np.int64) - (kind == CLOSE))))
        base = height[np.searchsorted(at, starts)]
        bad |= height[np.searchsorted(at, ends)] != base
        depth = height[1:] - base[row]
        bad[row[depth < 0]] = True
        at, kind, depth, row = self._without(bad, row, at, kind, depth, row)
        level = depth + (kind == CLOSE)
        order = np.argsort(level, kind="stable")
        # within a level the container of a mark is the last one opened
        holder = np.empty(len(at), np.int64)
        holder[order] = order[np.maximum.accumulate(np.where(kind[order] == OPEN, np.arange(len(order)), 0))] if len(order) else order
        in_object = data[at[holder]] == 0x7B
        bad[row[(level == 0) | (kind == CLOSE) & ((data[at] == 0x7D) != in_object)]] = True
        marks = marks[~bad[self.row(marks)]]
        bare = np.flatnonzero(outside & ~quote & ~BLANK[data] & (KIND[data] == 0))
        bare_row = self.row(bare)
        bare, bare_row = self._without(bad, bare_row, bare, bare_row)
        run, length = _runs(bare, bare_row)
        wrong = ~pc.match_substring_regex(substrings(data, bare[run], bare[run] + length), _SCALAR).to_numpy(zero_copy_only=False) if len(run) else run
        bad[bare_row[run][wrong]] = True
        bad[self.row(np.flatnonzero((data < 0x20) & ~outside))] = True
        if len(escaped):
            unicode = escaped[data[escaped] == 0x75]
            digits = _HEX[data[np.minimum(unicode[:, None] + np.arange(1, 5), max(len(data) - 1, 0))]].all(1) & (unicode + 4 < len(data))
            bad[self.row(np.concatenate((escaped[~_ESCAPES[data[escaped]]], unicode[~digits])))] = True
        place = np.concatenate((at, marks[0::2], bare[run]))
        code = np.concatenate((_CODE[data[at]], np.full(len(marks) // 2, _CODES["S"]), np.full(len(run), _CODES["N"])))
        kinds = np.concatenate((np.where(kind == COMMA, np.where(in_object, 2, 3), _CLASS[_CODE[data[at]]]), np.full(len(code) - len(at), 6)))
        order = np.argsort(place, kind="stable")
        place, code, kinds = place[order], code[order], kinds[order]
        of = self.row(place)
        new = np.diff(of, prepend=-1) != 0
        behind = np.concatenate(([6], kinds[:-1]))
        kinds = np.where((code == _CODES["S"]) & ~new & ((behind == 0) | (behind == 2)), 5, kinds)
        fits = np.where(new, _STARTS[code], _ALLOWED[np.concatenate(([6], kinds[:-1])), code]) if len(code) else new
        bad[of[~fits]] = True
        bad[of[np.append(new[1:], True) & (kinds != 6)] if len(code) else of] = True
        seen = np.zeros(len(ends), bool)
        seen[of] = True
        self.valid = ~bad & seen
        deep = np.zeros(len(ends), bool)
        deep[row[level > DEEP]] = True
        self.deep = np.flatnonzero(deep & self.valid)
        gone = ~self.valid | deep
        at, kind, depth = self._without(gone, row, at, kind, depth)
        marks = marks[~gone[self.row(marks)]]
        self.at, self.kind, self.depth, self.first, self.last = at, kind, depth, marks[0::2], marks[1::2]
        opened = kind == OPEN
        self.begin, self.level = at[opened], depth[opened]
        self.is_object = data[self.begin] == 0x7B
        self.of_level = self._by_level(np.arange(len(self.begin)), self.level)
        comma = kind == COMMA
        self.commas = self._by_level(at[comma], depth[comma])

    @staticmethod
    def _without(bad: np.ndarray, row: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
        keep = ~bad[row]
        return list(arrays) if keep.all() else [x[keep] for x in arrays]

    def _by_level(self, what: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[order], np.arange(1, (self.level.max() if len(self.level) else 0) + 2))
        return [what[order[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def holder(self, at: np.ndarray, level: int) -> np.ndarray:
        """Containers of a level (from 1) that hold the positions."""
        own = self.of_level[level - 1]
        return own[np.searchsorted(self.begin[own], at) - 1]

    def text(self, row: int) -> str:
        return self.data[self.starts[row] : self.ends[row]].tobytes().decode()

    def decoded(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """What the strings between the quotes say."""
        plain = substrings(self.data, first + 1, last)
        low, high = np.searchsorted(self.escaped, first), np.searchsorted(self.escaped, last)
        coded = np.flatnonzero((high > low) | pc.match_substring(plain, "\\").to_numpy(zero_copy_only=False))
        if not len(coded):
            return plain
        some = plain.take(pa.array(coded))
        # a lone surrogate has no UTF-8
        unicode = pc.match_substring(some, "\\u").to_numpy(zero_copy_only=False)
        out = unescaped(some)
        if unicode.any():
            said = [json.loads(f'"{v}"').encode("utf-8", "replace").decode() for v in some.filter(pa.array(unicode)).to_pylist()]
            out = pc.replace_with_mask(out, pa.array(unicode), pa.array(said, pa.large_string()))
        mask = np.zeros(len(plain), bool)
        mask[coded] = True
        return pc.replace_with_mask(plain, pa.array(mask), out)


def unescaped(texts: pa.Array) -> pa.Array:
    """Strings without their escapes, of one character each; those of four digits stay as they are."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    slash = np.flatnonzero(data == 0x5C)
    run, length = _runs(slash, np.searchsorted(offsets[1:], slash, side="right"))
    # of a run every other one, from the first, escapes what follows it
    escapes = slash[(np.arange(len(slash)) - np.repeat(run, length)) % 2 == 0]
    escapes = escapes[escapes + 1 < len(data)]
    data[escapes + 1] = _MEANT[data[escapes + 1]]
    keep = np.ones(len(data), bool)
    keep[escapes] = False
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[keep]))


TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)


def opened(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts, with those that are a JSON string of the text of a JSON value taken out of it, again and again, and whether
    each is a JSON object then. Nulls count as ''."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    is_object = np.zeros(len(texts), bool)
    open_ = np.arange(len(texts))
    current = texts
    while len(open_):
        tape = Tape(current)
        lead = pc.utf8_slice_codeunits(pc.utf8_ltrim(current, " \t\n\r"), 0, 1)
        is_object[open_] = tape.valid & pc.equal(lead, "{").to_numpy(zero_copy_only=False)
        strings = np.flatnonzero(tape.valid & pc.equal(lead, '"').to_numpy(zero_copy_only=False))
        if not len(strings):
            break
        inner = tape.decoded(tape.first[np.searchsorted(tape.first, tape.starts[strings])], tape.last[np.searchsorted(tape.first, tape.starts[strings])])
        # only what says an object, an array or a string again is opened
        more = pc.match_substring_regex(inner, r'^[ \t\n\r]*[{\["]').to_numpy(zero_copy_only=False)
        open_, current = open_[strings[more]], inner.filter(pa.array(more))
        if len(open_):
            mask = np.zeros(len(texts), bool)
            ok = Tape(current).valid
            open_, current = open_[ok], current.filter(pa.array(ok))
            mask[open_] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), current)
    return texts, is_object


_EMPTY = r"^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*(?:(?:\[[ \t\n\r]*\]|\{[ \t\n\r]*\})[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*)?$"


def filled(texts: pa.Array) -> np.ndarray:
    """How many top-level fields of the JSON object (opened) are not null, blank, [] or {}, also as text; 0 for what is no
    object. Of a repeated key the last field counts."""
    texts, is_object = opened(texts)
    out = np.zeros(len(texts), np.int64)
    rows = np.flatnonzero(is_object)
    if not len(rows):
        return out
    tape = Tape(texts.filter(pa.array(is_object)))
    for k in tape.deep:  # the outermost level alone is read
        out[rows[k]] = _filled_deep(tape.text(int(k)))
    colon = tape.at[(tape.kind == COLON) & (tape.depth == 1)]
    if not len(colon):
        return out
    data, begin = tape.data, colon + 1
    while (blank := BLANK[data[begin]]).any():
        begin = begin + blank
    lead = data[begin]
    good = lead != 0x6E
    container = (lead == 0x7B) | (lead == 0x5B)
    if container.any():
        after = begin[container] + 1
        while (blank := BLANK[data[after]]).any():
            after = after + blank
        good[container] = (data[after] != 0x7D) & (data[after] != 0x5D)
    string = np.flatnonzero(lead == 0x22)
    if len(string):
        which = np.searchsorted(tape.first, begin[string])
        good[string] = ~pc.match_substring_regex(tape.decoded(tape.first[which], tape.last[which]), _EMPTY).to_numpy(zero_copy_only=False)
    own = tape.row(colon)
    key = np.searchsorted(tape.first, colon) - 1
    names = tape.decoded(tape.first[key], tape.last[key]).dictionary_encode()
    code = own * len(names.dictionary) + names.indices.to_numpy(zero_copy_only=False)
    if len(np.unique(code)) < len(code):
        last = len(code) - 1 - np.unique(code[::-1], return_index=True)[1]
        own, good = own[last], good[last]
    out[rows] += np.bincount(own, good, len(rows)).astype(np.int64)
    return out


def _filled_deep(text: str) -> int:
    fields: dict[str, bool] = {}
    depth, key, previous, opened_at = 0, None, "", None
    for token in (m.group() for m in TOKENS.finditer(text)):
        if token in "}]":
            depth -= 1
            if depth == 1 and key is not None:
                fields[key] = opened_at != previous or previous not in "{["
        elif depth == 1 and previous == ":":
            fields[key] = token != "null" and not (token[0] == '"' and re.match(_EMPTY.replace(r"\x{85}\p{Z}", r"\x85\s"), json.loads(token)))
        elif depth == 1 and token[0] == '"':
            key = json.loads(token)
        if token in "{[":
            depth += 1
            opened_at = token if depth == 2 else None
        previous = token
    return sum(fields.values())
