"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced again."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Before a single blank between two word characters a pre-token always starts, whatever surrounds it: no
#: alternative of the byte-level pattern takes a blank after something else, and no added token holds this.
STABLE = regex.compile(r"(?<=\w)(?=[ \n]\w)")
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256


def read_spec(path: str) -> dict:
    """A tokenizer file's content; ValueError unless it is of the kind that boundaries and merges are proven for here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    sound = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None,
        not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(STABLE.search(t["content"]) for t in spec["added_tokens"]),
    )
    if not all(sound):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    return spec


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizers library's model, with truncation, padding and the offset-trimming post-processor off."""
    from tokenizers import Tokenizer

    spec = read_spec(path)
    spec["truncation"] = spec["padding"] = spec["post_processor"] = None
    return Tokenizer.from_str(json.dumps(spec))


def _last_stable(text: str, low: int, high: int) -> int | None:
    """The last proven boundary x with low < x and x + 2 <= high."""
    found = None
    for m in STABLE.finditer(text, max(low + 1, 1), high):
        if m.start() + 2 <= high:
            found = m.start()
    return found


def chunk_spans(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """Token ids of ``text``, piece by piece; together they are those of the whole text.

    A chunk starts ``overlap`` characters before the last splice and is encoded with offsets.  The next splice is a
    boundary that is proven stable and starts a token in both chunks.  Where the overlap has none it is doubled,
    and in the end the chunk.
    """
    start = cut = 0  # the chunk's first character; the first one whose tokens are still to come
    length = chunk
    while True:
        end = min(start + length, len(text))
        enc = tok.encode(text[start:end], add_special_tokens=False)
        starts = np.fromiter((a for a, _ in enc.offsets), np.int64, len(enc.ids)) + start
        first = int(np.searchsorted(starts, cut)) if cut > start else 0
        if cut > start and (first == len(starts) or starts[first] != cut):
            start, length = max(0, cut - 2 * (cut - start)), length + (cut - start)  # no alignment: more context
            continue
        if end == len(text):
            yield enc.ids[first:]
            return
        wide, x = overlap, None
        while x is None and end - wide // 2 > cut + 1:
            x = _last_stable(text, max(cut, end - wide), end)
            if x is not None and starts[min(np.searchsorted(starts, x), len(starts) - 1)] != x:
                x = None
            wide *= 2
        if x is None:
            length *= 2
            continue
        yield enc.ids[first : int(np.searchsorted(starts, x))]
        start, cut, length = max(0, x - overlap), x, chunk


def count_texts(tok, texts: list[str | None], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    counts = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if t and len(t) <= chunk]
    for i in range(0, len(short), 256):
        part = short[i : i + 256]
        for k, enc in zip(part, tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
            counts[k] = len(enc)
    for i, t in enumerate(texts):
        if t and len(t) > chunk:
            counts[i] = sum(map(len, chunk_spans(tok, t, chunk, overlap)))
    return counts


def token_count(text: Column | str, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Column:
    """Number of tokens (long) of the whole text, as the tokenizers library gives them without special tokens added.

    Strings of added tokens inside a text are taken as the library does by default.  Null and empty texts have 0
    tokens; rows that repeat count each.  Another kind of tokenizer than plain byte-level BPE raises ValueError.  Memory beside the text itself is that of a chunk, as long as the text has a blank between two word
    characters somewhere; a text without any is encoded whole.  ``tokenizer_path`` has to be readable where
    tasks run.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok = load_tokenizer(tokenizer_path)
        for texts in batches:
            counts: list[int] = []
            for i in range(0, len(texts), 512):
                counts += count_texts(tok, texts[i : i + 512].to_pylist(), chunk_chars, overlap_chars)
            yield pa.array(counts, pa.int64())

    return F.arrow_udf(run, "bigint", F.ArrowUDFType.SCALAR_ITER)(text)
