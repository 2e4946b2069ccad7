"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashed word shingles.  A token that no other set holds is a miss in every pair, so a set with more of
these than it may miss has no partner; most sets go by this, which a part of their tokens shows.  The others order
their tokens alike, rare ones first.  A set's prefix is extended until, whichever tokens another similar set
lacks, the two still share a signature: a single token of the rare class or a pair of tokens of one part of the
frequent class.  Sets with a common signature are candidates; candidates are verified on their whole sets.

Only the classes of similarity are wanted, so the sets of a large signature are not paired with each other: a pivot
is verified against the others.  Where that leaves several classes, the signature is extended by one more token: one
in which its sets differ from the pivot.  Two similar sets that the pivot does not link share such tokens, and a
prefix of each set's differences, those that few sets around this pivot have first, holds one of them.  So near
copies with changes of their own part at once.  Small groups are paired, larger ones take a pivot again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import mix, shingles, word_hashes
from ._shared import connected_components, discard, likely_in, materialize, nearby_least, told_broadcasts

#: A token is frequent if so many sets or more hold it.  This decides cost, never results.
FREQUENT = 64
#: Frequent tokens of a prefix that fall into one part, on average.
PER_PART = 4
#: Groups of so many sets at most are paired where the pivot leaves several classes; larger ones are extended.
PAIRED = 32
#: The same for groups of an extended signature: there the places of the token in both sets rule most pairs out.
PAIRED_BY_PLACE = 1024
#: Whom a set of an extended signature may be linked with: role 0 with role 1 (it is linked to the pivot), role 1
#: with role 0, role 2 with role 2 (neither is linked to the pivot).
LINKED, BESIDE, APART = 0, 1, 2


def _sets(texts: list[str | None], n_words: int) -> Iterator[np.ndarray]:
    for words in word_hashes([(t or "").encode() for t in texts]):
        yield shingles(words, n_words)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _scan(n_words: int, every: int):
    """Per document its set's size and two halves of its digest, and the tokens divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                size, digest, sample = [], [], []
                for s in _sets(part["text"].to_pylist(), n_words):
                    size.append(len(s))
                    digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                    sample.append(s[s % np.uint64(every) == 0])
                h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                cols = [part["id"], part["at"], pa.array(size, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), _lists(sample)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "at", "n", "h1", "h2", "sample"])

    return run


def _tokens(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part["text"].to_pylist(), n_words))
                yield pa.RecordBatch.from_arrays([part["sid"], pa.array(list(map(len, sets)), pa.int64()), _lists(sets)], ["sid", "n", "tokens"])

    return run


def allowed_misses(n: int, percent: int) -> int:
    """How many of n tokens may be absent from any set whose Jaccard similarity is percent / 100 or more."""
    return n - -(-n * percent // 100)


def signatures(n: int, tokens: np.ndarray, held_by: np.ndarray, percent: int) -> np.ndarray:
    """Distinct 64-bit signatures of a set of ``n`` tokens, of which ``tokens``, in the order of all sets, are in other sets too.

    ``held_by`` says how many sets hold each.  After any ``allowed_misses`` tokens go, a prefix with that many and one
    more single tokens, or tokens of a part beyond its first, still has a signature.  Tokens of this set only lie
    before the others and go first.  Parts depend on the size class of the larger of two sets; a set whose larger
    partners reach into the next class has the signatures of both.

    A prefix is always long enough: parts are n / 4 at most (one for n < 4) as percent is over 50, so the tokens
    have 3n / 4 useful ones or more, less those of this set only, and n / 2 + 1 less those are needed at most.
    """
    common = held_by >= FREQUENT
    need = allowed_misses(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return np.zeros(0, np.uint64)
    level = n.bit_length() - 1
    top = (n * 100 // percent).bit_length() - 1
    found = []
    for lv in range(level, top + 1):
        parts = max(1, (1 << lv) * (100 - percent) // (100 * PER_PART))
        part = np.where(common, (tokens % np.uint64(parts)).astype(np.int64), -1)
        useful = ~common
        at = np.flatnonzero(common)
        if len(at):
            first = np.zeros(len(at), bool)
            first[np.unique(part[at], return_index=True)[1]] = True
            useful[at[~first]] = True
        size = int(np.searchsorted(np.cumsum(useful), need)) + 1
        head, head_part = tokens[:size], part[:size]
        found.append(mix(head[head_part < 0]))
        for p in np.unique(head_part[head_part >= 0]):
            own = np.sort(head[head_part == p])
            a, b = np.triu_indices(len(own), 1)
            found.append(mix(mix(own[a] + np.uint64(lv + 1)) * np.uint64(3) + own[b]))
    return np.unique(np.concatenate(found))


def _sign(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                ids, sizes, own, rare, found = [], [], [], [], []
                tokens, held = part["tokens"], part["held_by"]
                for i, (sid, n, r) in enumerate(zip(part["sid"].to_pylist(), part["n"].to_pylist(), part["rare"].to_pylist(), strict=True)):
                    t = tokens[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    sig = signatures(n, t, held[i].values.to_numpy(zero_copy_only=False), percent)
                    found.append(sig.view(np.int64))
                    for col, x in zip((ids, sizes, own, rare), (sid, n, n - len(t), r), strict=True):
                        col.append(np.full(len(sig), x, np.int64))
                cols = [np.concatenate(x) for x in (ids, sizes, own, rare, found)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["sid", "n", "own", "rare", "sig"])

    return run


def _whole(x: Column, by: int) -> Column:
    """x divided by ``by``, rounded down, for any sign."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def _differences(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Extended signatures of the sets b around pivots a: (sig, sid, n, own, rare, label, role, far, rest).

    With p, a and b the sizes of the pivot's and two similar sets, A and B their differences from the pivot and C that
    between the two, C <= r * (a + b) where r = (100 - percent) / (100 + percent), and the differences share
    (A + B - C) / 2 tokens.  If b is not linked to the pivot, B > r * (b + p), hence B - C > r * (p - a).  If it is, B is
    1 or |b - p| at least, hence B - C >= 1 - r * (a + p + 1).  B >= A - C too, and C <= a * (100 - percent) / percent.

    Around a pivot, differences that only one set has come first, then those of two, and so on; the pivot's own
    tokens, absent from every set, come last and are one difference here (token null).

    ``far`` is B, ``rest`` how many differences there are from the signature's on.  Two sets share no more than the
    lesser rest from their first common difference on, so less than (A + B - r * (a + b)) / 2 rules the pair out there.
    """
    col, low, high = F.col, 100 - percent, 100 + percent
    p = around.join(sets.select(col("sid").alias("b"), col("n").alias("nb"), col("own").alias("ob"), "rare", col("tokens").alias("tb")), "b")
    p = p.join(sets.select(col("sid").alias("a"), col("n").alias("na"), col("own").alias("oa"), col("tokens").alias("ta")), "a")
    p = p.withColumn("differ", F.concat(F.array_except("tb", "ta"), F.array_except("ta", "tb"))).withColumn("size", F.size("differ") + col("oa") + col("ob"))
    p = p.withColumn("most", F.expr(f"nb * {low} div {percent}"))  # C at most

    def prefix(least: Column) -> Column:
        shared = F.greatest(F.lit(1), _whole(1 + col("size") + F.greatest(least, col("size") - 2 * col("most")), 2))
        return F.greatest(F.lit(0), col("size") - shared + 1)

    short = prefix(_whole(low * (col("na") - col("nb")), high) + 1)
    linked = col("size") * high <= low * (col("na") + col("nb"))
    beside = (col("size") - col("most")) * (high * percent) <= low * (100 * col("nb") + percent * col("na"))
    long_ = prefix(1 - _whole(low * (col("na") + col("nb") + 1), high))
    roles = F.when(linked, F.array(F.struct(F.lit(LINKED).alias("role"), short.alias("length")))).otherwise(
        F.array(F.struct(F.lit(APART).alias("role"), short.alias("length")), F.struct(F.lit(BESIDE).alias("role"), F.when(beside, long_).otherwise(F.lit(0)).alias("length")))
    )
    # what lies before the differences that others share too: all of b's own tokens, and later those that prove to be of one set
    p = p.select("a", "b", "label", col("nb").alias("n"), col("ob").alias("own"), "rare", col("size").alias("far"), (col("size") - col("oa")).alias("size"), roles.alias("roles"), F.concat("differ", F.when(col("oa") > 0, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("differ"))
    p = materialize(p, "differences")
    flat = p.select("a", "b", F.explode("differ").alias("token"))
    count = flat.groupBy("a", "token").agg(F.count(F.lit(1)).alias("held_by")).filter("held_by > 1")
    count = count.select("a", col("token").alias("t"), F.when(col("token").isNull(), F.lit((1 << 63) - 1)).otherwise(col("held_by")).alias("held_by"))
    both = flat.join(count.withColumnRenamed("a", "around"), (col("a") == col("around")) & col("token").eqNullSafe(col("t")))
    order = both.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("held_by", "token"))).alias("order"))
    out = p.drop("differ").join(order, ["a", "b"]).withColumn("role", F.explode("roles"))
    shared = F.size(F.filter("order", lambda x: x["token"].isNotNull()))
    take = F.greatest(F.lit(0), col("role.length") - (col("size") - shared)).cast("int")
    out = out.select("a", "label", "n", "own", "rare", "far", (col("far") - col("size") + shared).alias("rest"), col("b").alias("sid"), col("role.role").alias("role"), F.posexplode(F.slice("order", F.lit(1), take)).alias("at", "x"))
    return out.select(F.xxhash64("a", (col("role") == APART).cast("int"), F.coalesce("x.token", F.lit(0)), col("x.token").isNull().cast("int")).alias("sig"), "sid", "n", "own", "rare", "label", "role", "far", (col("rest") - col("at")).alias("rest"))


def ngram_join(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles (its set's size), component_id.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set is its distinct
    ``n_words``-word shingles, or with fewer words the whole sequence as one.  Two documents link when the Jaccard
    similarity of their sets is ``percent`` / 100 or more (exactly, in whole numbers); component_id is the smallest
    id reachable by links.

    Null, empty and blank texts have no shingles and link with nothing.  A null id has a null component.  Rows that share an id are one
    document, linked by any of their texts; each keeps its row.  Ids are cast to long.  An empty table gives no
    rows; other columns are ignored.  Tokens are 64-bit hashes of shingles, sets are told apart by 128 bits.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("at"))
    with told_broadcasts(docs.sparkSession):
        each, classes = _classes(rows, n_words, percent)
    out = each.select("id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2")).join(classes.hint("merge"), ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("component_id"))


def _classes(rows: DataFrame, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text, at): each one's set (id, n, h1, h2), and each set's (h1, h2, class)."""
    every = max(1, -(-50 // max(1, 100 - percent)))  # of 100 tokens of one set only, so many still show twice what may be missed
    each = materialize(rows.mapInArrow(_scan(n_words, every), "id long, at long, n long, h1 long, h2 long, sample array<bigint>"), "sets")
    known = each.filter("id is not null and n > 0")
    # copies of one set are one from here on: the smallest id stands for them
    copies = materialize(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("at", "id").alias("at"), F.min("n").alias("n")), "copies")
    # sets so small that only equal ones are similar need no more
    allowed = f"(n - (n * {percent} + 99) div 100)"
    may = f"({allowed} > 0 or n * 100 div {percent} > n)"
    once = known.filter(may).select("h1", "h2", F.explode("sample").alias("token"))
    once = once.groupBy("token").agg(F.min("h1").alias("h1"), F.max("h1").alias("high"), F.min("h2").alias("h2")).filter("h1 = high")
    once = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("once"))
    alive = copies.filter(may).join(once, ["h1", "h2"], "left").filter(f"coalesce(once, 0) <= {allowed}")
    alive = materialize(alive.select("rep", "at", F.monotonically_increasing_id().alias("sid")), "alive")
    found = likely_in(rows, F.xxhash64("id", "at"), alive, F.xxhash64("rep", "at"))
    found = found.join(alive.withColumnRenamed("rep", "id"), ["id", "at"]).select("sid", "text")
    tokens = materialize(found.mapInArrow(_tokens(n_words), "sid long, n long, tokens array<bigint>"), "tokens")
    # a token that one set alone holds matters by its number only
    flat = tokens.select("sid", "n", F.explode("tokens").alias("token"))
    held = flat.groupBy("token").agg(F.count(F.lit(1)).alias("held_by")).filter("held_by > 1")
    sets = flat.join(held, "token").groupBy("sid", "n").agg(F.array_sort(F.collect_set(F.struct("held_by", "token"))).alias("t"))
    sets = sets.filter(f"n - size(t) <= {allowed}").select("sid", "n", (F.col("n") - F.size("t")).alias("own"), F.col("t.token").alias("tokens"), F.col("t.held_by").alias("held_by"))
    # how rare a set's tokens are: one that k sets hold counts 1 / k, in millionths
    rare = F.col("own") * 1_000_000 + F.aggregate("held_by", F.lit(0).cast("long"), lambda s, k: s + F.floor(F.lit(1_000_000) / k))
    sets = materialize(sets.withColumn("rare", rare), "shared-tokens")
    discard(tokens)

    signed = materialize(sets.mapInArrow(_sign(percent), "sid long, n long, own long, rare long, sig long"), "signatures")
    first = F.min(F.struct("rare", "sid", "n", "own")).alias("pivot")  # the set with the least rare tokens is nearest to all
    groups = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), first).filter("size > 1")
    members = materialize(signed.join(groups, "sig"), "members")

    def close(p: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and own tokens allow a link."""
        wide = f"{percent} * (na + nb) <= {100 + percent} * least(na - oa, nb - ob)"
        return p.filter(wide).select("a", "b").distinct()

    def pivoted(m: DataFrame) -> DataFrame:
        m = m.filter("sid <> pivot.sid")
        return m.select(F.col("pivot.sid").alias("a"), F.col("pivot.n").alias("na"), F.col("pivot.own").alias("oa"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob"))

    def paired(m: DataFrame) -> DataFrame:
        """Members of one small group and different classes that may link."""
        cols = {"sid": "", "n": "n", "own": "o", "role": "role_", "label": "label_", "far": "far_", "rest": "rest_"}
        x, y = (m.select("sig", *[F.col(c).alias(f"{short}{side}") for c, short in cols.items()]) for side in "ab")
        p = x.join(y, "sig").filter(f"a < b and label_a <> label_b and (role_a <> role_b or role_a = {APART})")
        high = 100 + percent
        p = p.filter(f"rest_a is null or 2 * {high} * least(rest_a, rest_b) >= {high} * (far_a + far_b) - {100 - percent} * (na + nb)")
        return p.select("a", "na", "oa", "b", "nb", "ob")

    def linked(p: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        p = p.join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
        p = p.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
        return p.withColumn("both", F.size(F.array_intersect("ta", "tb"))).filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")

    links = materialize(linked(materialize(close(pivoted(members)), "pairs")), "links")
    labels = nearby_least(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "sid")  # most of each class
    all_links = links
    members = members.filter("size > 2").join(labels, "sid", "left").withColumn("label", F.coalesce("component_id", "sid")).withColumn("role", F.lit(APART))
    members = members.withColumns({"far": F.lit(None).cast("long"), "rest": F.lit(None).cast("long")})
    most = PAIRED
    while True:
        # groups that still hold several classes: small ones are paired, large ones told apart by differences from the pivot
        mixed = members.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
        members = materialize(members.join(mixed, "sig", "left_semi").select("sig", "sid", "n", "own", "rare", "label", "role", "far", "rest", "size", "pivot"), "mixed")
        pairs = paired(members.filter((F.col("size") <= most) & (F.col("sid") != F.col("pivot.sid"))))
        around = members.filter((F.col("size") > most) & (F.col("sid") != F.col("pivot.sid"))).groupBy(F.col("pivot.sid").alias("a"), F.col("sid").alias("b")).agg(F.min("label").alias("label"))
        around = materialize(around, "around")
        if around.isEmpty():
            all_links = all_links.union(materialize(linked(materialize(close(pairs), "pairs")), "links"))
            break
        most = PAIRED_BY_PLACE
        extended = materialize(_differences(around, sets, percent), "extended")
        groups = extended.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rare", "sid", "n", "own", "label")).alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("role").alias("r0"), F.max("role").alias("r1"))
        groups = groups.filter(f"low <> high and (r0 = {APART} or r0 = {LINKED} and r1 = {BESIDE})").select("sig", "size", "pivot")
        members = materialize(extended.join(groups, "sig"), "members")
        links = materialize(linked(materialize(close(pivoted(members).union(pairs)), "pairs")), "links")
        all_links = all_links.union(links)
        # for the next turn, a set that this group's pivot links is of the pivot's class
        mark = members.join(links.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("pivot.sid") == F.col("_a")) & (F.col("sid") == F.col("_b")), "left")
        members = mark.withColumn("label", F.when(F.col("_b").isNotNull(), F.col("pivot.label")).otherwise(F.col("label")))

    names = alive.select("sid", "rep")
    edges = all_links.join(names.select(F.col("sid").alias("a"), F.col("rep").alias("u")), "a").join(names.select(F.col("sid").alias("b"), F.col("rep").alias("v")), "b").select("u", "v")
    # an id that occurs with several sets joins them
    several = known.groupBy("id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.min("h2").alias("low2"), F.max("h2").alias("high2")).filter("low <> high or low2 <> high2")
    joined = known.join(several, "id").select("id", "h1", "h2").distinct().join(copies, ["h1", "h2"]).select(F.col("id").alias("u"), F.col("rep").alias("v"))
    labels = connected_components(edges.union(joined))
    classes = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("class"))
    return each, materialize(classes, "classes")
