"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder."""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .token_count import read_spec

WINDOW_CHARS = 1 << 16
CACHE_PIECES = 200_000
#: The pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern's own white space; the regex library's \s has four control characters more.
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = "[^" + SPACE[1:]
PIECE = regex.compile(PATTERN.replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"(?!\S)", f"(?!{NOT_SPACE})").replace(r"\s", SPACE))
LETTERS, NUMBERS, BLANKS = regex.compile(r" ?\p{L}"), regex.compile(r" ?\p{N}"), regex.compile(SPACE)
RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "P": regex.compile(rf"(?:(?!{SPACE})[^\p{{L}}\p{{N}}])*"), "S": regex.compile(f"{SPACE}*")}


def byte_names() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return names


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a position that decide whether a token ends there.

    A merge j = (a, b) over a position takes place if b is a token then, which the bytes of b tell unless an earlier
    merge i < j crosses the end of b.  Such an i has a left side that agrees with b up to the shorter of the two, and
    needs its own right side and, in turn, what may cross the end of that: chains have falling ranks, so one pass
    over the merges in their order finds the longest.
    """
    by_left: dict[bytes, int] = {}  # largest need of merges so far by left side
    by_suffix: dict[bytes, int] = {}  # and by each suffix of the left side
    most = 0
    for a, b in merges:
        deep = by_suffix.get(b, 0)
        for k in range(1, len(b)):
            deep = max(deep, by_left.get(b[k:], 0))
        need = len(b) + deep
        most = max(most, need)
        by_left[a] = max(by_left.get(a, 0), need)
        for k in range(len(a)):
            if by_suffix.get(a[k:], 0) < need:
                by_suffix[a[k:]] = need
    return most


class Bpe:
    """Vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        spec = read_spec(path)
        names = byte_names()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {k: bytes(names[c] for c in k) for k in model["vocab"] if k not in self.special}
        self.id_of = {raw[k]: i for k, i in model["vocab"].items() if k in raw}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(bytes(names[c] for c in a), bytes(names[c] for c in b)) for a, b in pairs]
        made = {a + b: r for r, (a, b) in enumerate(merges)}
        if len(made) != len(merges) or any(made.get(x, -1) >= r for r, m in enumerate(merges) for x in m):
            raise ValueError("a merge uses a token before it is made")
        self.merge = {(self.id_of[a] << 32) | self.id_of[b]: (r, self.id_of[a + b]) for r, (a, b) in enumerate(merges)}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(merges)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token: merges in the order of their rank, left to right."""
        ids = [self.single[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merge = self.merge.get
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge((ids[i] << 32) | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := merge((new << 32) | ids[k]):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := prv[i]) >= 0 and (m := merge((ids[h] << 32) | new)):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def pack(self, piece: str) -> bytes:
        """Little-endian ids of a short pre-token, kept in a bounded cache."""
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        self.cache[piece] = out = np.array(self.encode_bytes(piece.encode()), "<u4").tobytes()
        return out


class LongPiece:
    """A pre-token that arrives in parts: tokens leave once the lookahead behind them is there."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held = bpe, b""

    def feed(self, part: str) -> bytes:
        self.held += part.encode()
        if len(self.held) < 2 * self.bpe.lookahead + 4096:
            return b""
        ids, end, k = self.bpe.encode_bytes(self.held), 0, 0
        for x in ids:
            if end + len(self.bpe.bytes_of[x]) > len(self.held) - self.bpe.lookahead:
                break
            end, k = end + len(self.bpe.bytes_of[x]), k + 1
        self.held = self.held[end:]
        return np.array(ids[:k], "<u4").tobytes()

    def finish(self) -> bytes:
        out, self.held = np.array(self.bpe.encode_bytes(self.held), "<u4").tobytes(), b""
        return out


def _kind(piece: str) -> str:
    if BLANKS.fullmatch(piece[0]) and (len(piece) == 1 or BLANKS.fullmatch(piece[1])):
        return "S"
    return "L" if LETTERS.match(piece) else "N" if NUMBERS.match(piece) else "P"


def _encode_plain(bpe: Bpe, parts: Iterable[str], window: int) -> Iterator[bytes]:
    """Ids of a text without special strings that arrives in parts.

    A pre-token is final once two characters behind it are there.  What is not final is carried on; if that grows
    over a window it is one long pre-token, which goes on as a run of its class.
    """
    carry, long, kind = "", None, ""
    for part in parts:
        buf = carry + part
        carry = ""
        if long is not None:
            run = RUNS[kind].match(buf).end()
            if kind == "S":  # the last blank goes with what follows
                run = max(0, run - 1)
            yield long.feed(buf[:run])
            buf = buf[run:]
            if not buf or (kind == "S" and len(buf) == 1):
                carry = buf
                continue
            yield long.finish()
            long = None
        last = len(buf) - 2
        pieces = PIECE.findall(buf)
        size = len(buf)
        while pieces and size > last:  # from the end: drop what is not final
            size -= len(pieces.pop())
        carry = buf[size:]
        if pieces:
            yield b"".join([bpe.cache.get(p) or bpe.pack(p) for p in pieces])
        if len(carry) > window:
            first = PIECE.match(carry).group()
            if len(first) >= len(carry) - 2 and len(first) > 8:
                long, kind = LongPiece(bpe), _kind(first)
                run = len(first) - (kind == "S")
                yield long.feed(first[:run])
                carry = carry[run:]
    if long is not None:
        run = RUNS[kind].match(carry).end()
        yield long.feed(carry[:run])
        yield long.finish()
        carry = carry[run:]
    if carry:
        yield b"".join([bpe.cache.get(p) or bpe.pack(p) for p in PIECE.findall(carry)])


def encode_stream(bpe: Bpe, text: str, window: int = WINDOW_CHARS) -> Iterator[bytes]:
    """Packed ids (little-endian unsigned 32-bit) of ``text``, a window at a time."""

    def parts(a: int, b: int) -> Iterator[str]:
        return (text[i : min(i + window, b)] for i in range(a, b, window))

    at = 0
    for m in bpe.split.finditer(text) if bpe.split else ():
        yield from _encode_plain(bpe, parts(at, m.start()), window)
        yield bpe.special[m.group()].to_bytes(4, "little")
        at = m.end()
    yield from _encode_plain(bpe, parts(at, len(text)), window)


def decode_stream(bpe: Bpe, parts: Iterable[bytes]) -> Iterator[str]:
    """Text of packed ids; bytes that end a part inside a character wait for the next one."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    table = bpe.bytes_of.__getitem__
    for part in parts:
        yield machine.decode(b"".join(map(table, np.frombuffer(part, "<u4").tolist())))
    yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def load_bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_text(bpe: Bpe, text: str | None, window: int = WINDOW_CHARS) -> bytes:
    return b"".join(encode_stream(bpe, text or "", window))


def decode_ids(bpe: Bpe, ids: bytes | None, window: int = WINDOW_CHARS) -> str:
    raw = ids or b""
    return "".join(decode_stream(bpe, (raw[i : i + 4 * window] for i in range(0, len(raw), 4 * window))))


def bpe_encode(text: Column | str, tokenizer_path: str, window_chars: int = WINDOW_CHARS) -> Column:
    """Ids of the whole text as binary: little-endian unsigned 32-bit numbers.

    Null and empty texts: no bytes.  Of a very long text a window and the lookahead are held beside text and ids.
    Another kind of tokenizer than plain byte-level BPE raises ValueError.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load_bpe(tokenizer_path)
        for texts in batches:
            yield pa.array([encode_text(bpe, t.as_py(), window_chars) for t in texts], pa.binary())

    return F.arrow_udf(run, "binary", F.ArrowUDFType.SCALAR_ITER)(text)


def bpe_decode(ids: Column | str, tokenizer_path: str, window_ids: int = WINDOW_CHARS) -> Column:
    """Text of packed ids, special tokens written out; bytes that are no UTF-8 become U+FFFD.

    Null ids: empty text.  An id that the tokenizer has not raises KeyError.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load_bpe(tokenizer_path)
        for many in batches:
            yield pa.array([decode_ids(bpe, x.as_py(), window_ids) for x in many], pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(ids)


def bpe_round_trip(text: Column | str, tokenizer_path: str, window: int = WINDOW_CHARS) -> Column:
    """Struct of ids, as bpe_encode gives them, and decoded, as bpe_decode gives it of these ids.

    A task has one Python worker for both; bpe_decode on top of bpe_encode has two at a time, each with the tokenizer's tables.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load_bpe(tokenizer_path)
        for texts in batches:
            ids = [encode_text(bpe, t.as_py(), window) for t in texts]
            decoded = pa.array([decode_ids(bpe, x, window) for x in ids], pa.string())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    return F.arrow_udf(run, "struct<ids binary, decoded string>", F.ArrowUDFType.SCALAR_ITER)(text)
