"""Arrow-batched functions for what Spark's built-ins cannot express."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_LIST = T.ArrayType(T.StringType())
HASH_LIST = T.ArrayType(T.LongType())


@F.pandas_udf(T.StringType())
def nfkc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


@F.arrow_udf(T.IntegerType())
def token_count(texts: pa.Array) -> pa.Array:
    """Number of white-space-delimited tokens."""
    return pa.array([None if t is None else len(t.split()) for t in texts.to_pylist()], pa.int32())


def cut_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Split at the coarsest separator present; oversize parts go on to the finer ones.

    A separator stays at the head of the part that follows it.  Parts are packed into
    pieces of at most `size` characters, each starting with up to `overlap` characters
    of whole parts from the end of its predecessor.  A part that no separator can divide is
    kept as it is, however long.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1 :]
    if sep == "":
        parts = list(text)
    else:
        first, *rest = text.split(sep)
        parts = [p for p in (first, *(sep + r for r in rest)) if p]

    pieces: list[str] = []
    small: list[str] = []
    for part in parts:
        if len(part) < size:
            small.append(part)
            continue
        pieces += _pack(small, size, overlap)
        small = []
        pieces += cut_recursively(part, size, overlap, finer) if finer else [part]
    return pieces + _pack(small, size, overlap)


def _pack(parts: list[str], size: int, overlap: int) -> list[str]:
    pieces: list[str] = []
    start = width = 0
    for end, part in enumerate(parts):
        if width + len(part) > size and start < end:
            pieces.append("".join(parts[start:end]).strip())
            while width > overlap or (width and width + len(part) > size):
                width -= len(parts[start])
                start += 1
        width += len(part)
    if start < len(parts):
        pieces.append("".join(parts[start:]).strip())
    return [p for p in pieces if p]


def recursive_chunks(size: int, overlap: int, separators: tuple[str, ...]):
    """Arrow function `text -> array<string>`."""
    if overlap > size:
        raise ValueError("overlap exceeds chunk size")

    @F.pandas_udf(TEXT_LIST)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [] if t is None or not t.strip() else cut_recursively(t, size, overlap, separators)
        )

    return split


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _feed(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def _utf8(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 length of every code point and its bytes, one row per byte position."""
    size = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    lead = np.choose(size - 1, [0, 0xC0, 0xE0, 0xF0]).astype(np.uint32)
    rows = np.zeros((4, len(cp)), dtype=np.uint32)
    for b in range(4):
        shift = np.maximum(6 * (size.astype(np.int32) - 1 - b), 0).astype(np.uint32)
        bits = cp >> shift
        rows[b] = (lead | bits) if b == 0 else (0x80 | (bits & 0x3F))
    return size, rows


def _shingle_registers(cp: np.ndarray, width: int) -> np.ndarray:
    """CRC register after each `width`-character window of the code points, in UTF-8."""
    n = len(cp) - width + 1
    state = np.full(n, _ONES, dtype=np.uint32)
    for k in range(width):
        state = _feed(state, cp[k : k + n])
    # Windows with a character of several bytes are done again.
    wide = cp >= 0x80
    at = np.flatnonzero(np.logical_or.reduce([wide[k : k + n] for k in range(width)]))
    if len(at):
        size, rows = _utf8(cp)
        some = np.full(len(at), _ONES, dtype=np.uint32)
        for k in range(width):
            for b in range(4):
                has = size[at + k] > b
                if has.any():
                    some = np.where(has, _feed(some, rows[b, at + k]), some)
        state[at] = some
    return state


@cache
def _suffixes(perms: int) -> list[tuple[int, np.uint32]]:
    """Digits of each `j` and the register they leave when fed to an empty one."""
    out = []
    for j in range(perms):
        register = np.zeros(1, dtype=np.uint32)
        for digit in str(j):
            register = _feed(register, np.uint32(ord(digit)))
        out.append((len(str(j)), register[0]))
    return out


def crc_minhash(texts: list[str], perms: int, width: int) -> np.ndarray:
    """Row t, column j: `min over shingles of texts[t] of crc32(shingle + str(j))`.

    Every text must have at least one shingle.  CRC-32 is a running register and linear in
    its state and its input: the digits of `j` change the register after a shingle, moved on by as many
    zero bytes, by one constant.  So tables are looked up once per shingle and number of digits.
    """
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.ones(len(cp), dtype=bool)
    for back in range(1, width):
        inside[ends - back] = False
    state = _shingle_registers(cp, width)[inside[: len(cp) - width + 1]]
    windows = lengths - width + 1
    starts = np.cumsum(windows) - windows
    out = np.empty((perms, len(texts)), dtype=np.uint32)
    for some, block in _blocks(starts, windows):
        fed, registers = 0, state[block]
        changed = np.empty_like(registers)
        for j, (digits, constant) in enumerate(_suffixes(perms)):
            while fed < digits:
                registers, fed = _feed(registers, np.uint32(0)), fed + 1
            np.bitwise_xor(registers, constant, out=changed)
            # The final inversion turns the minimum of the CRC into the maximum of the register.
            out[j, some] = changed.max(axis=0)
    return (out ^ _ONES).T.astype(np.int64)


def _blocks(starts: np.ndarray, windows: np.ndarray, texts: int = 256, cells: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of similar length, and the places of their shingles, a column per text; short ones are filled up with their last shingle."""
    order = np.argsort(-windows, kind="stable")
    at = 0
    while at < len(order):
        longest = windows[order[at]]
        some = order[at : at + max(1, min(texts, cells // longest))]
        yield some, starts[some] + np.minimum(np.arange(longest)[:, None], windows[some] - 1)
        at += len(some)


def minhash(perms: int = 64, width: int = 5, slice_chars: int = 100_000):
    """Arrow function `text -> array<bigint>` with one value per permutation; null without shingles.

    Equal texts of an Arrow batch are signed once.
    """

    def sign(texts: pa.Array) -> pa.Array:
        signed = np.zeros(len(texts), dtype=bool)
        parts: list[np.ndarray] = []
        cleans: list[str] = []
        chars = 0
        for row, text in enumerate(texts.to_pylist()):
            clean = "" if text is None else "".join(text.lower().split())
            if len(clean) >= width:
                signed[row] = True
                cleans.append(clean)
                chars += len(clean)
            if chars >= slice_chars:
                parts.append(crc_minhash(cleans, perms, width).ravel())
                cleans, chars = [], 0
        if cleans:
            parts.append(crc_minhash(cleans, perms, width).ravel())
        values = pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64))
        # A null offset makes a null list.
        ends = np.cumsum(signed) * perms
        starts = pa.array(np.append(ends - signed * perms, ends[-1:] if len(ends) else 0).astype(np.int32), mask=np.append(~signed, False))
        return pa.ListArray.from_arrays(starts, values)

    @F.arrow_udf(HASH_LIST)
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = texts.dictionary_encode()
            yield sign(found.dictionary).take(found.indices)

    return signature
