"""Remove byte strings that an earlier document holds: induced suffix sorting through external queues.

Not all suffixes are sorted.  As in induced sorting, suffixes at sampled places come first: every string of
``match`` bytes has one among its first ``gap`` places, where the fingerprint of the next match + 1 - gap bytes is
least.  A run of neighbouring suffixes with one sampled place is a stretch, and its suffix tuple (name of
the sampled prefix, name of the whole stretch, document, place, length) goes into a queue: tuples leave each batch as
sorted runs, spill with Spark's shuffle, and are merged by name.  Equal names are a common prefix of match + 1 - gap
bytes; equal stretches are a common prefix of ``match`` bytes for every suffix in them.  Where the first is shared
and the second is not, the stretch's own suffixes are induced one level down: their tuples go through a second
queue, where equal names are a common prefix of ``match`` bytes.  Order inside a queue is that of the names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashing import eights, mix
from ._shared import materialize, ordered_numbers, small_batches

STEP = 1 << 16  # bytes fingerprinted at once
RUN_TUPLES = 300_000  # tuples of a sorted run
BUCKET_TUPLES = 500_000  # tuples that are merged at once
TRAVEL, DECIDED, INDUCE = 0, 1, 2
FIELDS = [("name", np.uint64), ("whole", np.uint64), ("doc", np.int64), ("start", np.int64), ("length", np.int64), ("state", np.uint8)]
Tuples = dict[str, np.ndarray]


@lru_cache(maxsize=4)
def _powers(size: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(salt)
    base = int(rnd.integers(1 << 40, 1 << 62)) * 8 + 5
    up, down = np.full(size, base % (1 << 64), np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), rnd.integers(1, 1 << 63, 256, dtype=np.uint64)


class Names:
    """Fingerprints of any parts of ``least`` to STEP + match bytes, from running sums.

    What is summed are not bytes but mixed numbers of up to eight neighbouring bytes: sums of the bytes' own values times powers
    modulo 2^64 have pairs of texts in common whatever the base.
    """

    def __init__(self, part: np.ndarray, match: int, least: int, salt: int = 50):
        self.up, down, value = _powers(STEP + match + 1, salt)
        self.gram = min(8, least)
        own = value[part]
        if self.gram > 1:
            short = np.uint64(64 - 8 * self.gram)
            own = mix((eights(part)[:-1] << short) ^ value[self.gram])
        self.total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(own * down[: len(part)], out=self.total[1:])

    def every(self, size: int) -> np.ndarray:
        """Of all parts of ``size`` bytes."""
        n = size - self.gram + 1
        sums = (self.total[n:] - self.total[:-n]) * self.up[: len(self.total) - n]
        return mix(sums[: len(self.total) - size])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b - self.gram + 1] - self.total[a]) * self.up[a] + (b - a).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _chunks(n: int, match: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n - match + 1, STEP):
        yield a, min(a + STEP, n - match + 1)


def stretches(data: np.ndarray, ends: np.ndarray, match: int, gap: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, whole, start, length) of the stretches of texts that lie one after another and end at ``ends``.

    A stretch is a run of neighbouring suffixes, of ``match`` bytes each, whose sampled prefix has one name.
    """
    good = np.ones(len(data), bool)
    for k in range(1, match):  # suffixes that are too short
        at = ends - k
        good[at[at >= 0]] = False
    for a, b in _chunks(len(data), match):
        at = np.flatnonzero(good[a:b])
        if not len(at):
            continue
        names = Names(data[a : b + match - 1], match, match + 1 - gap)
        key = _least(names.every(match + 1 - gap), gap)[at]
        first = np.ones(len(at), bool)
        first[1:] = (key[1:] != key[:-1]) | (np.diff(at) != 1)
        cut = np.flatnonzero(first)
        start, last = at[cut], at[np.append(cut[1:] - 1, len(at) - 1)]
        yield key[cut], names.of(start, last + match), start + a, last - start + 1


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of each row's group, where rows are sorted by ``keys``."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _take(t: Tuples, at: np.ndarray) -> Tuples:
    return {k: v[at] for k, v in t.items()}


def _join(parts: list[Tuples]) -> Tuples:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in FIELDS}


def _joined_runs(t: Tuples) -> Tuples:
    """Decided tuples of one document that follow each other, as one."""
    t = _take(t, np.lexsort((t["start"], t["doc"])))
    if not len(t["doc"]):
        return t
    new = np.ones(len(t["doc"]), bool)
    new[1:] = (t["doc"][1:] != t["doc"][:-1]) | (t["start"][1:] > t["start"][:-1] + t["length"][:-1])
    cut = np.flatnonzero(new)
    out = _take(t, cut)
    out["length"] = np.maximum.reduceat(t["start"] + t["length"], cut) - out["start"]
    return out


def settle(t: Tuples, per_id: int, last_level: bool, merged: bool) -> Tuples:
    """What a run or a merged bucket tells of its tuples.

    A tuple whose whole name an earlier document has is decided.  On the first level, where several documents share
    a name and not the whole, the others are to be induced; a run then sends one tuple without length in their
    stead, so that a name that everyone has does not meet in one place.  ``merged``: nothing travels on.
    """
    done = t["state"] != TRAVEL
    kept, t = [_take(t, done)], _take(t, ~done)
    t = _take(t, np.argsort(t["name"]))
    same = np.zeros(len(t["name"]), bool)
    if len(same):
        same[1:] = t["name"][1:] == t["name"][:-1]
        same[:-1] |= same[1:]
    if not merged:
        kept.append(_take(t, ~same))
    t = _take(t, same)
    if len(t["name"]):
        t = _take(t, np.lexsort((t["start"], t["doc"], t["whole"], t["name"])))
        order, real = t["doc"] // per_id, t["length"] > 0
        by_name, by_whole = _groups(t["name"]), _groups(t["name"], t["whole"], real)
        head = np.flatnonzero(np.append(True, by_whole[1:] != by_whole[:-1]))
        decided = real & (order > order[head][by_whole])
        top = np.flatnonzero(np.append(True, by_name[1:] != by_name[:-1]))
        low, high = np.minimum.reduceat(order, top), np.maximum.reduceat(order, top)
        wholes = np.append(by_whole[top[1:] - 1], by_whole[-1]) > by_whole[top]  # several
        ghost = np.logical_or.reduceat(~real, top)
        induce = np.zeros(len(top), bool) if last_level else ((low < high) & wholes) | ghost
        rest = real & ~decided
        kept.append(_joined_runs(_take(t, decided) | {"state": np.full(int(decided.sum()), DECIDED, np.uint8)}))
        ask = rest & induce[by_name]
        kept.append(_take(t, ask) | {"state": np.full(int(ask.sum()), INDUCE, np.uint8)})
        if not merged:
            kept.append(_take(t, rest & ~induce[by_name]))
            n = int(induce.sum())
            kept.append({"name": t["name"][top[induce]], "whole": np.zeros(n, np.uint64), "doc": np.full(n, np.iinfo(np.int64).min), "start": np.zeros(n, np.int64), "length": np.zeros(n, np.int64), "state": np.full(n, TRAVEL, np.uint8)})
    return _join(kept)


def _pack(t: Tuples) -> bytes:
    """Byte planes, compressed: what neighbours in a sorted run share costs little."""
    planes = b"".join(np.ascontiguousarray(t[k]).view(np.uint8).reshape(len(t[k]), -1).T.tobytes() for k, _ in FIELDS)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(n: int, packed: bytes) -> Tuples:
    planes = np.frombuffer(pa.decompress(packed, n * 41, codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for k, kind in FIELDS:
        size = np.dtype(kind).itemsize * n
        out[k] = np.ascontiguousarray(planes[at : at + size].reshape(-1, n).T).view(kind).ravel()
        at += size
    return out


def _run(parts: list[Tuples], buckets: int, per_id: int, last_level: bool) -> Iterator[pa.RecordBatch]:
    """One sorted run, in a packed row for each bucket of names."""
    t = settle(_join(parts), per_id, last_level, merged=False)
    if not len(t["name"]):
        return
    bucket = (mix(t["name"]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((t["name"], bucket))
    t, bucket = _take(t, order), bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = [(int(bucket[a]), int(b - a), _pack(_take(t, slice(a, b)))) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True)]
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 256], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "n", "pack"])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts of a column without nulls, and where each ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _sample(match: int, gap: int, buckets: int, per_id: int):
    """First queue: the tuples of all stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch["id"].to_numpy()
            data, at = _texts(batch["text"])
            for name, whole, start, length in stretches(data, at[1:], match, gap):
                own = np.searchsorted(at[1:], start, "right")
                held.append({"name": name, "whole": whole, "doc": ids[own], "start": start - at[own], "length": length, "state": np.full(len(name), TRAVEL, np.uint8)})
                n += len(name)
                if n >= RUN_TUPLES:
                    yield from _run(held, buckets, per_id, False)
                    held, n = [], 0
        yield from _run(held, buckets, per_id, False)

    return run


def _induce(match: int, buckets: int, per_id: int):
    """Second queue: the tuples of each suffix of the stretches that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch["id"].to_numpy()
            data, at = _texts(batch["text"])
            asked = batch["asked"].flatten()
            a, size = asked.field("start").to_numpy(), asked.field("length").to_numpy()
            a = a + np.repeat(at[:-1], batch["asked"].value_lengths().to_numpy())
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, a, 1)
            np.add.at(edge, a + size, -1)
            wanted = np.cumsum(edge[:-1]) > 0
            for lo, hi in _chunks(len(data), match):
                p = np.flatnonzero(wanted[lo:hi])
                if not len(p):
                    continue
                part = data[lo : hi + match - 1]
                own = np.searchsorted(at[1:], p + lo, "right")
                name, check = (Names(part, match, match, salt).of(p, p + match) for salt in (50, 51))
                held.append({"name": name, "whole": check, "doc": ids[own], "start": p + lo - at[own], "length": np.ones(len(p), np.int64), "state": np.full(len(p), TRAVEL, np.uint8)})
                n += len(p)
                if n >= RUN_TUPLES:
                    yield from _run(held, buckets, per_id, True)
                    held, n = [], 0
        yield from _run(held, buckets, per_id, True)

    return run


def _merge(runs: DataFrame, per_id: int, last_level: bool, what: str) -> DataFrame:
    """Merge the runs of each bucket; rows: doc, start, length, state."""

    def merge(table: pa.Table) -> pa.Table:
        t = settle(_join([_unpack(n, p) for n, p in zip(table["n"].to_pylist(), table["pack"].to_pylist(), strict=True)]), per_id, last_level, merged=True)
        return pa.table({k: t[k].astype(np.int64) for k in ("doc", "start", "length", "state")})

    return materialize(runs.groupBy("bucket").applyInArrow(merge, "doc long, start long, length long, state long"), what)


def _cut(match: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            kept, removed, runs = [], [], []
            for text, own in zip(texts, spans, strict=True):
                raw = text.as_buffer().to_pybytes()
                if not own.is_valid:
                    kept.append(raw)
                    removed.append(0)
                    runs.append(0)
                    continue
                a, size = (own.values.field(k).to_numpy() for k in ("start", "length"))
                order = np.argsort(a)
                a, b = a[order], np.maximum.accumulate((a + size + match - 1)[order])
                new = np.append(True, a[1:] > b[:-1])  # runs that touch are one
                start, end = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
                view = memoryview(raw)
                kept.append(b"".join(view[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(int((end - start).sum()))
                runs.append(len(start))
            yield pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])

    return run


def suffix_dedup(docs: DataFrame, match: int = 50, gap: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``cut``: n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that are left).

    Texts are UTF-8 bytes; each byte goes that is covered by a string of ``match`` bytes which also starts in a
    document with a smaller id.  Strings may overlap and are judged on the input; they never cross documents.
    ``gap`` is the largest distance of sampled places: it decides cost, never results.  What is kept may be no UTF-8.

    Null texts are empty; texts under ``match`` bytes lose nothing, whole texts are read however long.  Rows with one
    id are one document with several texts, which do not remove each other's bytes.  A null id is neither smaller nor larger: its row loses
    nothing and takes nothing.  Ids are cast to long.  An empty table gives no rows.  Columns of ``docs`` keep
    their names; one called ``cut`` is an error.  Names have 128 bits where they decide.
    """
    if "cut" in docs.columns:
        raise ValueError("a column is named cut already")
    if not 1 <= gap <= match:
        raise ValueError("gap is at least 1 and at most match")
    text = F.coalesce(F.col(text_col), F.lit(""))
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    seen = rows.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("z"))
    total, clash = seen.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max((F.col("a") != F.col("z")) & F.col("id").isNotNull()), F.lit(False))).first()
    per_id = 1
    if clash:  # number the ids in their order and the texts of each: number * per_id + text names one
        texts = rows.filter("id is not null").select("id", F.xxhash64("text").alias("h")).distinct()
        many = texts.join(seen.filter("a <> z").select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
        ids = ordered_numbers(seen.filter("id is not null").select("id"), "id", "number")
        many = materialize(ids.join(many, "id", "left"), "repeated-ids")
        per_id = many.agg(F.max(F.size("hs"))).first()[0]
        rows = rows.join(many, "id", "left").withColumn("id", F.col("number") * per_id + F.coalesce(F.array_position("hs", F.xxhash64("text")) - 1, F.lit(0))).drop("hs", "number")

    known = rows.filter(F.col("id").isNotNull() & (F.octet_length("text") >= match)).select("id", "text")
    runs = known.mapInArrow(_sample(match, gap, _buckets(total * 2 // (gap + 1)), per_id), "bucket long, n long, pack binary")
    first = _merge(runs, per_id, False, "stretches")
    asked = first.filter(f"state = {INDUCE}")
    n_asked = asked.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    asked = asked.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "length")).alias("asked"))
    runs = known.join(asked.hint("shuffle_hash"), "id").select("id", "text", "asked").mapInArrow(_induce(match, _buckets(n_asked), per_id), "bucket long, n long, pack binary")
    second = _merge(runs, per_id, True, "suffixes")
    spans = first.filter(f"state = {DECIDED}").union(second.filter(f"state = {DECIDED}"))
    spans = spans.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    cut = F.arrow_udf(_cut(match), "struct<n_removed bigint, n_spans bigint, kept binary>", F.ArrowUDFType.SCALAR_ITER)
    out = rows.join(spans.hint("shuffle_hash"), "id", "left").withColumn("c", cut("text", "spans"))
    return out.select("row.*", F.struct(F.octet_length("text").cast("long").alias("n_bytes"), "c.n_removed", "c.n_spans", "c.kept").alias("cut"))


def _buckets(tuples: int) -> int:
    return int(max(1, -(-tuples // BUCKET_TUPLES)))
