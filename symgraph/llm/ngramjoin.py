"""Exact n-gram Jaccard join with token-combination prefixes.

A document is its set of word n-grams, each held as a 64-bit hash. Documents
with equal sets are one set with copies. The join runs in steps:

1. Counting. For every hash in a fixed share of the hash space, a plain
   aggregation finds whether a single set holds it. A set with more such
   unique n-grams than the threshold leaves room for can have no partner.
   Most sets end here; no rows are compared.
2. Signatures. N-grams are put in one global order: unique ones, then the rare
   class by hash, then the frequent class by hash. A set's prefix is extended
   until its unique and rare n-grams, and its frequent ones less one, reach the
   length that the threshold asks for. Rare n-grams are indexed singly, frequent
   ones in pairs. Two linked sets share a signature: within the shorter prefix
   they share one n-gram if all are rare, else two, of which either one is rare
   or both are frequent. A set with many frequent n-grams in its prefix would
   have very many pairs; such a wide set indexes them singly instead, and every
   set indexes singly, too, those of its frequent ones that some wide set has.
   Signatures with the same members count once.
3. Linking. The sets under a signature are compared with one hub of theirs,
   linked sets are merged into components, and this repeats with other hubs.
   Where very many components are then left under one signature, its list is
   replaced by lists of that signature and one n-gram more, drawn from prefixes
   longer by one; two sets that share k n-grams and are linked share a further
   one there. Sets that still stand in different components under one signature
   are compared in blocks by their sketches, which bound the intersection from
   above; only pairs that the bound lets pass become rows and are verified.
   No link is lost, and a group of near copies never becomes rows of all pairs.

Comparisons are exact on the hashed sets. Two different n-grams or sets are
taken for equal only if their 64-bit hashes agree.

Cases: null and empty texts have an empty set and link with nothing. A text
with fewer words than n is one n-gram. Rows that repeat an id are one document
if their texts agree. Rows with a null id get a null component. An empty table
gives no rows. Texts are read whole. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, discard, free_name, join_by_key, map_texts

#: Share of the hash space whose n-grams are counted in step 1.
COUNTED = 0.3
#: N-grams in more prefixes than this are of the frequent class.
FREQUENT = 512
#: At most this many n-grams are held as frequent; the bound on counts doubles until they fit.
MAX_FREQUENT = 1 << 20
HUB_ROUNDS = 3
#: A sketch counts a set's n-grams in this many buckets.
BUCKETS = 512
#: Sets that one side of a block holds, and signatures that a block looks at, about.
BLOCK, BLOCK_SIGNATURES = 512, 128
#: A list with more components is replaced by lists of longer combinations, of up to so many n-grams; in blocks
#: each of its sets would be copied more often than its prefix has n-grams.
LONG, DEEPEST = 1 << 16, 5
#: A set with more frequent n-grams than this in its prefix indexes them singly.
PAIRED = 64
_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C
    return x ^ (x >> _S)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct word n-grams of a text as rising 64-bit hashes."""
    # Splitting and lower-casing bytes touches only the six white-space bytes and A-Z.
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(n, len(h))
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = g * _M + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(g + np.uint64(n)))


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64))


def least_shared(n: Column, percent: int) -> Column:
    """How many n-grams a set of size n must share with any partner."""
    return F.ceil(n * percent / F.lit(100.0))


def prefix_need(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def read_sets(docs: DataFrame, n: int, doc_id: str, text: str, with_hash: bool = False) -> DataFrame:
    """(doc_id, sid, n, sample): each document's set id, set size and counted n-grams; on request with ``text_hash``.

    The sample is null where this task has emitted the same set before, and for
    rows with a null id, which never stand for their set.
    """
    top = np.uint64(int(COUNTED * 2**64))

    def sets() -> object:
        seen: set[int] = set()

        def of(texts: list[str]) -> tuple[list, list, list]:
            ids, sizes, samples = [], [], []
            for t in texts:
                tokens = shingle_set(t[1:], n)
                sid = set_id(tokens) if len(tokens) else None
                ids.append(sid)
                sizes.append(len(tokens))
                if t[0] == "-":
                    samples.append(None)
                    continue
                samples.append(None if sid is None or sid in seen else tokens[: np.searchsorted(tokens, top)].view(np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
            return ids, sizes, samples

        return of

    columns = {"sid": ("long", pa.int64()), "n": ("long", pa.int64()), "sample": ("array<long>", pa.list_(pa.int64()))}
    known = F.col(doc_id).cast("long")
    # The first character tells whether the row has an id.
    marked = F.concat(F.when(known.isNull(), "-").otherwise("+"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    given = docs.select(known.alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), marked.alias("text"))
    state: list = []

    def once(texts: list[str]) -> tuple[list, list, list]:
        if not state:
            state.append(sets())
        return state[0](texts)

    return map_texts(given, ["doc_id", "text_hash"] if with_hash else ["doc_id"], columns, once)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def survivors(read: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sid, rep, n, copies) of all sets; and (sid, rep, alone) of those that may have a partner, with their unique n-grams."""
    known = read.where("doc_id IS NOT NULL AND sid IS NOT NULL")
    sets = cut(known.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "sets")
    holders = known.select("sid", F.explode("sample").alias("token")).groupBy("token").agg(F.min("sid").alias("sid"), F.max("sid").alias("other"))
    # A set's unique n-grams are at most its counted ones.
    unique = holders.where("sid = other").groupBy("sid").agg(F.collect_list("token").alias("alone"))
    alone = F.coalesce("alone", F.array().cast("array<long>"))
    left = sets.join(unique, "sid", "left").where(F.size(alone) <= F.col("n") - least_shared(F.col("n"), percent))
    return sets, cut(left.select("sid", "rep", alone.alias("alone")), "survivors")


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of the n-grams by bucket, as bytes; as 32-bit numbers if a count does not fit a byte."""
    counts = np.bincount((tokens & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def sketch_table(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows; 32-bit numbers if any of them is."""
    if all(len(x) == BUCKETS for x in sketches):
        return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BUCKETS)
    return np.array([np.frombuffer(x, np.uint8 if len(x) == BUCKETS else np.uint32) for x in sketches], dtype=np.uint32)


def set_tokens(docs: DataFrame, wanted: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(sid, n, tokens, alone, sketch) for the wanted (sid, rep, alone), read from one document each."""
    given = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(bounded(wanted.select("sid", "rep")), "rep")

    def of(texts: list[str | None]) -> tuple[list, list, list, list]:
        found = [shingle_set(t, n) for t in texts]
        return [set_id(t) for t in found], [len(t) for t in found], [t.view(np.int64) for t in found], list(map(sketch, found))

    columns = {"own": ("long", pa.int64()), "n": ("long", pa.int64()), "tokens": ("array<long>", pa.list_(pa.int64())), "sketch": ("binary", pa.binary())}
    # Rows that repeat an id may hold another text; those are not the wanted set.
    # Those that repeat both id and text are one set and count once.
    read = map_texts(given, ["sid"], columns, of).where("sid = own").dropDuplicates(["sid"])
    return read.join(wanted.select("sid", "alone"), "sid").select("sid", "n", "tokens", "alone", "sketch")


def frequent_tokens(sets: DataFrame, percent: int, bound: int = FREQUENT, most: int = MAX_FREQUENT) -> np.ndarray:
    """The frequent class, counted over prefixes with some slack.

    Any choice gives the same links; a good one keeps the lists short.
    """
    need = F.col("n") - least_shared(F.col("n"), percent) + 1
    reach = F.least(F.col("n"), need + F.floor(need / 2) + 16).cast("int")
    counts = sets.select(F.explode(F.slice("tokens", F.lit(1), reach)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = cut(counts.where(F.col("n") > bound), "frequent")
    while found.where(F.col("n") > bound).count() > most:
        bound *= 2
    rows = found.where(F.col("n") > bound).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(dtype=np.int64))


def in_order(tokens: np.ndarray, alone: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's rare and its frequent n-grams, each rising; ``tokens`` rise as unsigned numbers, ``alone`` are unique to the set and left out."""
    tokens = tokens[~np.isin(tokens, alone)]
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    common = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    return tokens[~common], tokens[common]


def prefix_classes(tokens: np.ndarray, alone: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rare and the frequent n-grams of a set's prefix."""
    need = prefix_need(len(tokens), percent) - len(alone)
    rare, common = in_order(tokens, alone, frequent)
    rare = rare[:need]
    return rare, common[: need - len(rare) + 1] if len(rare) < need else tokens[:0]


def named_signatures(tokens: np.ndarray, alone: np.ndarray, frequent: np.ndarray, wide: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signatures of one set, each kind with a row of n-grams for each; ``wide`` are the frequent ones that wide sets index singly, rising."""
    rare, common = prefix_classes(tokens, alone, frequent, percent)
    found = [(rare, rare[:, None])]
    if len(common) <= PAIRED:
        pairs = common.view(np.uint64)
        i, j = np.triu_indices(len(pairs), 1)
        found.append((mixed(pairs[i] * _M + mixed(pairs[j])).view(np.int64), np.stack((common[i], common[j]), axis=1)))
        # Small sets under a low threshold may be linked by a single one.
        if -(-len(tokens) * percent // 100) > 1:
            common = common[np.isin(common, wide)] if len(wide) else common[:0]
    # Mixed, so that a single one is no rare one's signature.
    found.append((mixed(common.view(np.uint64) + _M).view(np.int64), common[:, None]))
    return found


def set_signatures(tokens: np.ndarray, alone: np.ndarray, frequent: np.ndarray, wide: np.ndarray, percent: int) -> np.ndarray:
    return np.concatenate([sigs for sigs, _ in named_signatures(tokens, alone, frequent, wide, percent)])


def extended(parts: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The combination ``parts`` with each further n-gram of ``prefix``: signatures and their n-grams."""
    more = prefix[~np.isin(prefix, parts)]
    rows = np.sort(np.concatenate((np.broadcast_to(parts, (len(more), len(parts))), more[:, None]), axis=1), axis=1)
    sig = np.full(len(rows), rows.shape[1], np.uint64)
    for column in rows.T:
        sig = mixed(sig * _M + mixed(np.ascontiguousarray(column).view(np.uint64) + _C))
    return sig.view(np.int64), rows


def wide_tokens(sets: DataFrame, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The frequent n-grams in prefixes of wide sets; no more than there are frequent ones."""
    if not len(frequent):
        return frequent
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_classes(np.asarray(t.values), np.asarray(a.values), shared.value, percent)[1] for t, a in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([f for f in found if len(f) > PAIRED] or [shared.value[:0]])))], names=["token"])

    # Shorter sets have no prefix that long.
    long = sets.where(F.col("n") - least_shared(F.col("n"), percent) + 2 > PAIRED)
    rows = long.select("tokens", "alone").mapInArrow(run, "token long").distinct().toPandas()
    return np.sort(rows["token"].to_numpy(dtype=np.int64))


def signatures(sets: DataFrame, frequent: np.ndarray, wide: np.ndarray, percent: int) -> DataFrame:
    """(sig, sid, n)."""
    shared = sets.sparkSession.sparkContext.broadcast((frequent, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for sid, n, tokens, alone in zip(sids, ns, batch.column(2), batch.column(3), strict=True):
                found = set_signatures(np.asarray(tokens.values), np.asarray(alone.values), *shared.value, percent)
                size = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(size, sid)), pa.array(np.full(size, n))], names=["sig", "sid", "n"])

    return sets.select("sid", "n", "tokens", "alone").mapInArrow(run, "sig long, sid long, n long")


def longer_signatures(wanted: DataFrame, sets: DataFrame, frequent: np.ndarray, wide: np.ndarray, percent: int) -> DataFrame:
    """(sig, sid, n, parts, deeper): the signatures (sig, sid, parts) with one n-gram more.

    ``parts`` is null for signatures of :func:`signatures`. A set that may be
    linked by no more n-grams than its signature has keeps that one as well,
    with ``deeper`` false.
    """
    shared = sets.sparkSession.sparkContext.broadcast((frequent, wide))
    given = wanted.groupBy("sid").agg(F.collect_list(F.struct("sig", "parts")).alias("wanted")).join(sets.select("sid", "n", "tokens", "alone"), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, wide = shared.value
        for batch in batches:
            for sid, n, asked, tokens, alone in zip(*(batch.column(k) for k in range(5)), strict=True):
                sid, n, asked = sid.as_py(), n.as_py(), asked.as_py()
                tokens, alone = np.asarray(tokens.values), np.asarray(alone.values)
                known = [(w["sig"], np.array(w["parts"], np.int64)) for w in asked if w["parts"] is not None]
                first = np.array([w["sig"] for w in asked if w["parts"] is None], np.int64)
                for sigs, parts in named_signatures(tokens, alone, frequent, wide, percent) if len(first) else ():
                    at = np.isin(sigs, first)
                    known += zip(sigs[at].tolist(), parts[at], strict=True)
                ordered = np.concatenate(in_order(tokens, alone, frequent))
                need = prefix_need(len(tokens), percent) - len(alone)
                told: set[int] = set()
                for sig, parts in known:
                    # Linked sets share len(parts) + 1 n-grams within this reach.
                    found, rows = extended(parts, ordered[: need + len(parts)])
                    # The same combination may come from several that it extends.
                    new = np.array([x not in told for x in found.tolist()], bool)
                    told.update(found.tolist())
                    found, rows = found[new], rows[new]
                    deeper = np.ones(len(found), bool)
                    if -(-n * percent // 100) <= len(parts):
                        found, deeper = np.append(found, sig), np.append(deeper, False)
                    held = [*map(list, rows.tolist()), *[parts.tolist()] * (len(found) - len(rows))]
                    size = len(found)
                    columns = [pa.array(found, pa.int64()), pa.array(np.full(size, sid)), pa.array(np.full(size, n)), pa.array(held, pa.list_(pa.int64())), pa.array(deeper)]
                    yield pa.RecordBatch.from_arrays(columns, names=["sig", "sid", "n", "parts", "deeper"])

    return given.select("sid", "n", "wanted", "tokens", "alone").mapInArrow(run, "sig long, sid long, n long, parts array<long>, deeper boolean")


def long_lists(rows: DataFrame) -> DataFrame:
    """(sig) of the lists (sig, sid, comp) with more than LONG components."""
    large = rows.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > LONG).select("sig")
    large = cut(large, "large")
    if large.isEmpty():
        return large
    comps = rows.join(large, "sig", "left_semi").select("sig", "comp").distinct()
    return cut(comps.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > LONG).select("sig"), "long")


def shortened(split: DataFrame, labels: DataFrame, sets: DataFrame, classes: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """``split`` with its long lists replaced by lists of longer combinations, of which those within one component go."""
    long = long_lists(split)
    if long.isEmpty():
        return split
    kept = split.join(long, "sig", "left_anti").select("sig", "least", "sigs", "sid", "comp")
    asked = split.join(long, "sig", "left_semi").select("sig", "sid", F.lit(None).cast("array<long>").alias("parts"))
    done = []
    for _ in range(DEEPEST - 2):
        rows = cut(longer_signatures(asked, sets, *classes, percent), "longer")
        placed = rows.join(labels, "sid")
        long = long_lists(placed.where("deeper").select("sig", "sid", "comp"))
        done.append(rows.join(long, "sig", "left_anti").select("sig", "sid", "n"))
        asked = rows.where("deeper").join(long, "sig", "left_semi").select("sig", "sid", "parts")
        if long.isEmpty():
            break
    else:
        # Blocks take what is still long.
        done.append(rows.join(long, "sig", "left_semi").select("sig", "sid", "n"))
    index = done[0]
    for more in done[1:]:
        index = index.unionByName(more)
    lists = distinct_lists(index.distinct()).join(labels, "sid")
    apart = lists.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("sig")
    return kept.unionByName(lists.join(apart, "sig", "left_semi").select("sig", "least", "sigs", "sid", "comp"))


def distinct_lists(index: DataFrame) -> DataFrame:
    """(sig, least, width, sigs, sid, n, weight) of the signatures that count.

    Signatures that one set holds alone are left out, and of those with the
    same members one stays. ``least`` is a signature's least member, ``width``
    the longest list with that one, ``sigs`` the number of lists with it, and
    ``weight`` how much a set shares.
    """
    members = index.groupBy("sig").agg(
        F.count("*").alias("size"), F.min("sid").alias("least"), F.max("sid").alias("most"), F.bit_xor(F.xxhash64("sid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "sid")).alias("h2"),
        # Upper halves, so that the sum of a long list does not overflow.
        F.sum(F.shiftright(F.xxhash64(F.lit(11), "sid"), 32)).alias("h3"),
    )
    kept = cut(members.where("least <> most").groupBy("size", "least", "most", "h1", "h2", "h3").agg(F.min("sig").alias("sig"), F.count("*").alias("times")), "kept")
    kept = kept.join(kept.groupBy("least").agg(F.max("size").alias("width"), F.count("*").alias("sigs")), "least")
    lists = cut(index.join(kept.select("sig", "least", "width", "sigs", (F.col("size") * F.col("times")).alias("part")), "sig"), "lists")
    return cut(lists.join(lists.groupBy("sid").agg(F.sum("part").alias("weight")), "sid").select("sig", "least", "width", "sigs", "sid", "n", "weight"), "index")


def fits(a: Column, b: Column, percent: int) -> Column:
    """Sizes between which the threshold can be reached at all."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda name: sets.select(F.col("sid").alias(name), F.col("n").alias(f"n{name}"), F.col("tokens").alias(f"t{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).select("a", "b").distinct()


def bound_allows(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches leave room for the threshold, for each row of ``left`` against each of ``right``."""
    top = int(max(left.max(initial=0), right.max(initial=0)))
    if top <= 12:
        # The lesser of two counts is the number of levels that both reach.
        level = lambda m: np.concatenate([(m >= k) for k in range(1, top + 1)], axis=1).astype(np.float32) if top else np.zeros((len(m), 1), np.float32)
        shared = np.rint(level(left) @ level(right).T)
    else:
        shared = np.array([np.minimum(row, right).sum(axis=1, dtype=np.int64) for row in left]).reshape(len(left), len(right))
    return 100 * shared >= percent * (n_left[:, None] + n_right[None, :] - shared)


def sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    side = lambda name: sets.select(F.col("sid").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            shared = np.minimum(sketch_table(batch.column(4).to_pylist()), sketch_table(batch.column(5).to_pylist())).sum(axis=1, dtype=np.int64)
            keep = 100 * shared >= percent * (na + nb - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def block_pairs(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components under a signature that their sketches do not rule out.

    ``split`` holds (sig, least, sigs, sid, comp). Signatures with the same
    least member are handled together, dealt into parts where there are many, so
    a pair that shares many signatures is mostly told once. The sets of a part
    are one row each. They are dealt into blocks of bounded size, of which every
    two meet, but for those of the part's largest component among themselves.
    """
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.col("sigs") / F.lit(BLOCK_SIGNATURES))).cast("int").alias("part")
    held = cut(split.groupBy("least", part, "sid").agg(F.min("comp").alias("comp"), F.collect_list("sig").alias("held")), "held")
    sizes = held.groupBy("least", "part", "comp").agg(F.count("*").alias("size")).groupBy("least", "part")
    sizes = sizes.agg(F.max(F.struct("size", "comp")).alias("most"), F.sum("size").alias("all")).where("most.size < all")
    several = F.col("all") > BLOCK
    rest = F.when(several, F.ceil((F.col("all") - F.col("most.size")) / F.lit(BLOCK))).otherwise(1).cast("int")
    large = F.when(several, F.ceil(F.col("most.size") / F.lit(BLOCK))).otherwise(0).cast("int")
    placed = held.join(sizes.select("least", "part", F.when(several, F.col("most.comp")).alias("most"), rest.alias("rest"), large.alias("large")), ["least", "part"])
    among = F.coalesce(F.col("comp") == F.col("most"), F.lit(False))
    own = F.when(among, F.col("rest") + F.pmod(F.xxhash64("sid"), F.greatest("large", F.lit(1)))).otherwise(F.pmod(F.xxhash64("sid"), "rest")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(among, 0).otherwise(F.col("large")) - 1))
    known = placed.withColumn("own", own).join(sets.select("sid", "n", "sketch"), "sid")
    cells = known.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    keys = ["least", "part", "i", "j"]

    def meet(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, sid, comp, n = (table.column(c).to_numpy() for c in ("own", "sid", "comp", "n"))
        counts = sketch_table(table.column("sketch").to_pylist())
        lists = table.column("held").combine_chunks()
        sigs = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        holds = np.zeros((len(sid), int(sigs.max()) + 1), np.float32)
        holds[np.repeat(np.arange(len(sid)), lists.value_lengths().to_numpy()), sigs] = 1
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            good = (holds[part] @ holds[right].T > 0) & (comp[part][:, None] != comp[right][None, :])
            if i == j:
                good &= sid[part][:, None] < sid[right][None, :]
            if not good.any():
                continue
            good &= bound_allows(counts[part], counts[right], n[part], n[right], percent)
            x, y = np.nonzero(good)
            found.append(np.stack((sid[part[x]], sid[right[y]])))
        both = np.concatenate(found, axis=1)
        return pa.table({"a": np.minimum(both[0], both[1]), "b": np.maximum(both[0], both[1])})

    return cells.select(*keys, "own", "sid", "comp", "n", "sketch", "held").groupBy(*keys).applyInArrow(meet, "a long, b long")


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, comp) after merging the components that ``links`` (a, b) connect.

    Every component takes the least label among its neighbours and then the
    label of that label, until nothing changes.
    """
    of = lambda name: labels.select(F.col("sid").alias(name), F.col("comp").alias(f"c{name}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select("ca", "cb")
    edges = cut(edges.union(edges.select("cb", "ca")).distinct().toDF("u", "v"), "edges")
    roots = cut(edges.select("u", F.col("u").alias("root")).distinct(), "roots")
    while True:
        near = edges.join(roots.toDF("v", "rv"), "v").groupBy("u").agg(F.min("rv").alias("rv"))
        hooked = roots.join(near, "u").select("u", F.least("root", "rv").alias("root"), F.col("root").alias("old"))
        jumped = hooked.join(hooked.select(F.col("u").alias("root"), F.col("root").alias("next")), "root", "left")
        now = cut(jumped.select("u", F.least("root", F.coalesce("next", "root")).alias("root"), "old"), "roots")
        changed = now.where("root <> old").limit(1).count()
        roots = now.select("u", "root")
        if not changed:
            break
    moved = labels.join(roots.toDF("comp", "root"), "comp", "left")
    return cut(moved.select("sid", F.coalesce("root", "comp").alias("comp")), "labels")


def components(index: DataFrame, sets: DataFrame, classes: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(sid, comp) of the sets in ``index``, which comes from :func:`distinct_lists`; ``classes`` are the frequent and the wide n-grams.

    The first hub of a list is the member that shares most, later ones stand
    for components at random.
    """
    labels = cut(index.select("sid", F.col("sid").alias("comp")).distinct(), "labels")
    tested = None
    for turn in range(HUB_ROUNDS + 1):
        placed = index.join(labels, "sid")
        rank = F.xxhash64("comp", F.lit(turn)) if turn else -F.col("weight")
        hub = F.min(F.struct(rank.alias("rank"), "comp", "sid", "n"))
        hubs = placed.groupBy("sig").agg(hub.alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        if turn < HUB_ROUNDS:
            met = placed.join(hubs, "sig").where((F.col("comp") != F.col("hub.comp")) & fits(F.col("n"), F.col("hub.n"), percent))
            pairs = met.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b"))
        else:
            split = cut(placed.join(hubs.select("sig"), "sig", "left_semi").select("sig", "least", "sigs", "sid", "comp"), "split")
            pairs = block_pairs(shortened(split, labels, sets, classes, percent), sets, percent)
        pairs = pairs.distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = cut(verify(pairs if turn == HUB_ROUNDS else sketched(pairs, sets, percent), sets, percent), "links")
        if not links.isEmpty():
            labels = merge_components(labels, links)
    return labels


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", with_component: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Rows that repeat an id can be in several components with one
    ``component_id``. With ``with_component`` the columns ``component``, which
    tells components apart, and ``text_hash`` (see :func:`text_hash`) follow.
    """
    read = cut(read_sets(docs, n, doc_id, text, with_component), "read-sets")
    sets, left = survivors(read, percent)
    more = ["text_hash"] if with_component else []
    members = cut(read.select("doc_id", "sid", "n", *more), "members")
    discard(read)
    tokens = cut(set_tokens(docs, left, n, doc_id, text), "set-tokens")
    frequent = frequent_tokens(tokens, percent)
    classes = frequent, wide_tokens(tokens, frequent, percent)
    index = cut(signatures(tokens, *classes, percent), "index")
    labels = components(distinct_lists(index), tokens, classes, percent)
    placed = sets.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    label = [F.col("comp").alias("component")] if with_component else []
    known = cut(placed.join(least, "comp").select("sid", "component_id", *label, "copies"), "set-components")
    in_sets = members.where("doc_id IS NOT NULL AND sid IS NOT NULL")
    total = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    linked = join_by_key(in_sets, known, "sid", "copies", total)
    alone = members.where("doc_id IS NULL OR sid IS NULL").withColumn("component_id", F.col("doc_id"))
    if not with_component:
        return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = alone.withColumn("component", F.lit(None).cast("long"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "text_hash")


def one_of_each(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, that of the least text hash.

    Decisions are by id and text, so where rows repeat an id, one that resembles
    nothing stays whatever becomes of the others. Of equal rows one stays. Rows
    without an id or without words are linked with nothing and stay.
    """
    found = cut(link_documents(docs, n, percent, doc_id, text, with_component=True).where("component IS NOT NULL").drop("n_shingles"), "near-links")
    later = found.where("component_id < doc_id").select("doc_id", "text_hash")
    first = found.where("component_id = doc_id").groupBy("component").agg(F.min("text_hash").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    several = cut(found.where("component_id = doc_id").join(first, "component").select("doc_id", "text_hash", "first"), "near-several")
    gone = bounded(cut(later.unionByName(several.where("text_hash <> first").select("doc_id", "text_hash")).distinct(), "near-gone"))
    twice = several.where("text_hash = first").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1")
    twice = cut(twice.select("doc_id", "text_hash"), "near-twice")
    key, h = free_name(docs, "__id"), free_name(docs, "__hash")
    marked = docs.withColumns({key: F.col(doc_id).cast("long"), h: text_hash(F.col(text))})
    of = lambda df: df.select(F.col("doc_id").alias(key), F.col("text_hash").alias(h))
    left = marked.join(of(gone), [key, h], "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    pairs = bounded(of(twice))
    once = left.join(pairs, [key, h], "left_semi").dropDuplicates([key, h])
    return left.join(pairs, [key, h], "left_anti").unionByName(once).select(*docs.columns)
