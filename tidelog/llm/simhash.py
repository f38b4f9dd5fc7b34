"""SimHash near-duplicates with pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints become one class.
Classes are dealt into groups by masks: the 64 bits are cut into ``blocks`` parts of which any
``blocks - 4`` are taken as a key, so two fingerprints that differ in at most 4 bits agree on a
key (pigeonhole, exact). Inside a group a table holds every fingerprint's Hamming distances to
PIVOTS reference fingerprints; by the triangle inequality a pair whose distances to some pivot
differ by more than the radius can't link, so the largest coordinate difference discards it, and
only survivors are compared bit by bit. A group gives a spanning star for each of its linked sets,
never all pairs. Links are then contracted to components in DataFrame rounds.

Groups above CHUNK members (``link_groups``) are cut into chunks. Each chunk is linked by itself; the middle
members of its largest linked sets are compared with each other and then with every chunk, which joins
what is one family; and only chunks that hold different sets after that are compared pairwise. So a large
family costs its members once or twice, nothing is left out, and no group is held whole. The number of blocks
follows the count of classes, which keeps mean groups small at any size and changes no result.

``keep_one_near`` has a contract of its own: texts link if their sets of five-word shingles have a
Jaccard similarity of at least 0.8. It takes the same steps with SimHashes of PRINT_BITS bits of those sets.
Two such sets are at most 27.3 degrees apart, so a bit differs with probability 0.151 at most, and the odds that
more than NEAR_RADIUS of 256 do are below 1e-12 (3e-8 for sets of four and five shingles, of which 0.1875 differ).
No exact set of masks reaches that far, so ``near_masks`` takes random ones, as many as it needs for a pair at
the threshold to agree on none with odds of MISS. Random pivots can't tell such prints apart (distances to one
spread by 8), so in each group some members far from each other are the pivots: pairs whose distances to one
differ by more than the radius are discarded, survivors are compared bit by bit, and links give groups of
candidates. In those an exact check follows, on the sets themselves, with pivot tables of Jaccard distances (a metric too).

Edge cases: null and wordless texts have fingerprint zero and link like any other; fewer words than a
shingle has are one shingle; repeated rows each get their row; a null id is not a vertex (its
component_id is null); rows of one id with different texts are all linked to that id's group; very long texts
are hashed whole; other columns pass through ``keep_one`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

SHINGLE, SEED, RADIUS = 4, 42, 4
PIVOTS = 16
#: Members of a group that one task compares with each other.
CHUNK = 512
#: Mean members of a group that the number of blocks aims at.
MEAN_GROUP = 64
#: Linked sets of a chunk, the largest first, whose middle members are compared with those of other chunks.
MIDDLES = 8
#: ``keep_one_near``: words of a shingle, and the least Jaccard similarity of a link as a fraction.
NEAR_SHINGLE, NEAR = 5, (4, 5)
#: Bits of the SimHash of a set, how many of them may differ in candidates, and the odds that a pair at the threshold agrees on no mask.
PRINT_BITS, NEAR_RADIUS, MISS = 256, 84, 5e-8
#: Below so many shingles a majority is decided by few of them, and up to this share of bits differs in a link (four against five).
SHORT, SHORT_SHARE = 8, 0.1875
#: Pivots of a group of candidates, and shingles of the sets that one task compares with each other.
NEAR_PIVOTS, CHUNK_SHINGLES = 8, 1 << 20


def shingle_hashes(text, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words (of all words if there are fewer), in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def fingerprint(text) -> int:
    """The 64-bit SimHash of one text."""
    hashes = shingle_hashes(text, SHINGLE)
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    h = np.array(hashes, dtype=">u8")
    for at in range(0, len(h), 65_536):  # bits of a very long text are summed piece by piece
        part = h[at : at + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """``docs`` and the fingerprint as a (signed) long."""
    compute = lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]
    return common.with_added(docs, text_col, [(out_col, pa.int64(), T.LongType())], compute)


def masks(n_classes: int) -> list[int]:
    """Bit masks of which two fingerprints within the radius agree on one at least."""
    for blocks in range(RADIUS + 1, 12):
        if n_classes / 2 ** (64 * (blocks - RADIUS) / blocks) <= MEAN_GROUP:
            break
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - RADIUS)]


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(PIVOTS)], dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def _links(group: np.ndarray, fps: np.ndarray, label: np.ndarray | None = None, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) row pairs that span the linked sets inside equal, neighbouring ``group`` values.

    Rows of equal ``label`` aren't compared (they are known to be one set), and pairs must begin before row ``first``.
    """
    n = len(fps)
    table = pivot_table(fps)
    left, right = [], []
    reach = np.arange(n)  # union-find over rows
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, n))
    end_of = np.repeat(start + size, size)
    at = np.arange(n if first is None else min(first, n))
    for gap in range(1, int(size.max()) if n else 0):
        at = at[at + gap < end_of[at]]
        if not len(at):
            break
        a = at if label is None else at[label[at] != label[at + gap]]
        for p in range(PIVOTS):
            a = a[np.abs(table[a, p] - table[a + gap, p]) <= RADIUS]
        a = a[np.bitwise_count(fps[a] ^ fps[a + gap]) <= RADIUS]
        if len(a):
            left.append(a)
            right.append(a + gap)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    while True:  # smallest row reached, by hooking and jumping
        low = np.minimum(reach[a], reach[b])
        was = reach.copy()
        np.minimum.at(reach, reach[a], low)
        np.minimum.at(reach, reach[b], low)
        np.minimum.at(reach, a, low)
        np.minimum.at(reach, b, low)
        reach = reach[reach]
        if (reach == was).all():
            break
    member = np.flatnonzero(reach != np.arange(n))
    return reach[member], member


def fp_pairs(prints: list[bytes], label: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs that span the linked sets of fingerprints (8 bytes each)."""
    fps = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64)
    a, b = _links(np.zeros(len(fps), np.int64), fps, label, first)
    return list(zip(a.tolist(), b.tolist(), strict=True))


def fp_middle(prints: list[bytes]) -> int:
    """The fingerprint nearest to the bits that most of them have."""
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1)
    return int((bits != (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1).argmin())


def class_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that span the linked sets of ``classes(vertex long, fp long)``, fps distinct."""
    spark = classes.sparkSession
    keep = masks(classes.count())
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in keep]
    keyed = classes.select("vertex", "fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("mask", "m"))
    keyed = keyed.select("vertex", "fp", "mask", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    large = common.materialize(keyed.groupBy("mask", "key").count().where(F.col("count") > CHUNK).select("mask", "key"), "large")
    small = keyed if large.isEmpty() else keyed.join(large, ["mask", "key"], "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.select(F.xxhash64("mask", "key").alias("g"), "mask", "key", "vertex", "fp")
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "mask", "key", "fp").select("g", "mask", "key", "vertex", "fp")

    def link(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                now, held = held, None
            else:
                columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                now = columns if held is None else [np.concatenate([x, y]) for x, y in zip(held, columns, strict=True)]
                ids = np.stack([c.astype(np.int64) for c in now[:3]], axis=1)
                last = int((ids != ids[-1]).any(axis=1).sum()) if len(ids) else 0
                held, now = [c[last:] for c in now], [c[:last] for c in now]
            if now is None or not len(now[0]):
                continue
            ids = np.stack([c.astype(np.int64) for c in now[:3]], axis=1)
            group = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]).any(axis=1).astype(np.int64)]))
            a, b = _links(group, now[4].astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(now[3][a], pa.int64()), pa.array(now[3][b], pa.int64())], names=["a", "b"])

    links = dealt.mapInArrow(link, "a long, b long")
    if large.isEmpty():
        return links
    members = keyed.join(large, ["mask", "key"], "left_semi")
    members = members.select(F.xxhash64("mask", "key").alias("k"), F.col("vertex").alias("v"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("x"))
    members = common.materialize(members, "members")
    return links.unionByName(link_groups(members, fp_pairs, fp_middle))


def _middles(links: list[tuple[int, int]], xs: list[bytes], middle) -> list[int]:
    """The middle members of the largest sets that ``links`` join."""
    group: dict[int, list[int]] = {}
    of = {}
    for a, b in links:
        x, y = of.get(a, a), of.get(b, b)
        if x != y or a not in of:
            whole = group.pop(x, [x]) + (group.pop(y, [y]) if y != x else [])
            group[x] = whole
            for i in whole:
                of[i] = x
    top = sorted(group.values(), key=len, reverse=True)[:MIDDLES]
    return [g[middle([xs[i] for i in g])] for g in top]


def _compared(rows: DataFrame, compare, middle=None) -> DataFrame:
    """(k, a, b, x) for each group of ``rows(k, i, j, v, x, label, hub)``: links (a, b), and with ``middle`` a row (a, x) for each middle member.

    Rows marked ``hub`` are compared with all others and nothing else is; otherwise rows of different ``label`` are compared.
    """
    n_groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // CHUNK)
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("k", "i", "j"), F.lit(n_groups)))

    def run(some: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (k, _, _), part in some.groupby(["k", "i", "j"], sort=False):
            part = part.sort_values(["hub", "v"], ascending=[False, True], kind="stable")
            v, xs, hubs = part["v"].tolist(), part["x"].tolist(), int(part["hub"].sum())
            links = compare(xs, part["label"].to_numpy(), hubs or None)
            out += [(k, v[a], v[b], None) for a, b in links]
            if middle is not None:
                out += [(k, v[i], None, xs[i]) for i in _middles(links, xs, middle)]
        return pd.DataFrame(out, columns=["k", "a", "b", "x"]).astype({"k": "Int64", "a": "Int64", "b": "Int64"})

    return common.materialize(dealt.groupBy("g").applyInPandas(run, "k long, a long, b long, x binary"), "compared")


def link_groups(members: DataFrame, compare, middle) -> DataFrame:
    """Links (a, b) that span the linked sets inside each group of ``members(k, v, x)``: group, vertex and what is compared.

    ``compare(xs, label, first)`` gives pairs of rows, ``middle(xs)`` the row most like all others.
    """
    half, heavy = CHUNK // 2, CHUNK_SHINGLES // 2
    parts = lambda n, w: F.greatest(F.when(n > CHUNK, F.ceil(n / half)).otherwise(1), F.when(w > CHUNK_SHINGLES, F.ceil(w / heavy)).otherwise(1)).cast("int")
    sum_of = [F.count("*").alias("n"), F.sum(F.length("x") / 8).alias("w")]
    alone = {"j": F.lit(0), "label": F.col("v"), "hub": F.lit(False)}
    links_of = lambda out: out.where("b IS NOT NULL").select("a", "b")
    sizes = common.materialize(members.groupBy("k").agg(*sum_of).select("k", parts(F.col("n"), F.col("w")).alias("chunks")), "sizes")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return links_of(_compared(members.withColumns({"i": F.lit(0), **alone}), compare))
    small = members.join(sizes.where("chunks = 1"), "k", "left_semi")
    some = common.materialize(members.join(large, "k").withColumn("i", F.pmod(F.xxhash64("v"), F.col("chunks"))), "members")
    found = [links_of(_compared(small.withColumns({"i": F.lit(0), **alone}), compare))]

    # Each chunk by itself, then middles with middles until a task holds a group's, then those with every chunk.
    out = _compared(some.drop("chunks").withColumns(alone), compare, middle)
    found.append(links_of(out))
    hubs = out.where("x IS NOT NULL").select("k", F.col("a").alias("v"), "x").distinct()
    while True:
        count = hubs.groupBy("k").agg(*sum_of).select("k", parts(F.col("n"), F.col("w")).alias("chunks"))
        again = hubs.join(count, "k").withColumn("i", F.pmod(F.xxhash64(F.lit("again"), "v"), F.col("chunks")))
        several = not count.where("chunks > 1").isEmpty()
        out = _compared(again.drop("chunks").withColumns(alone), compare, middle)
        found.append(links_of(out))
        middles = out.where("x IS NOT NULL").select("k", F.col("a").alias("v"), "x").distinct()
        # Middles without a link among themselves stay candidates: a family whose middles are apart may still meet in a member.
        hubs = middles if several else hubs.join(middles.select("k").distinct(), "k", "left_anti").unionByName(middles)
        if not several:
            break
    everywhere = hubs.join(large, "k").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    mixed = some.drop("chunks").join(hubs.select("k", "v"), ["k", "v"], "left_anti").withColumns(alone)
    mixed = mixed.unionByName(everywhere.withColumns({**alone, "hub": F.lit(True)}))
    found.append(links_of(_compared(mixed.join(hubs.select("k").distinct(), "k", "left_semi"), compare)))

    # What is left: chunks that hold different sets.
    so_far = found[0]
    for more in found[1:]:
        so_far = so_far.unionByName(more)
    named = some.drop("i", "chunks").join(components(so_far), F.col("v") == F.col("vertex"), "left")
    named = common.materialize(named.select("k", "v", "x", F.coalesce("component", "v").alias("label")), "named")
    sets = named.groupBy("k", "label").agg(*sum_of)
    apart = sets.groupBy("k").count().where("count > 1").select("k")
    sets = sets.join(apart, "k", "left_semi").withColumn("own", (F.col("n") > half) | (F.col("w") > heavy))
    rest = sets.where("NOT own").groupBy("k").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    chunks = sets.where("own").select("k", "label", parts(F.col("n"), F.col("w")).alias("chunks")).unionByName(rest.select("k", F.lit(None).cast("long").alias("label"), parts(F.col("n"), F.col("w")).alias("chunks")))
    chunks = common.materialize(chunks, "chunks")
    lists = chunks.select("k", "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("no")).groupBy("k").agg(F.collect_list(F.struct("label", "no")).alias("all"))
    own = named.join(chunks.where("label IS NOT NULL"), ["k", "label"]).withColumns({"pure": F.col("label"), "no": F.pmod(F.xxhash64("v"), F.col("chunks"))}).drop("chunks")
    rest = named.join(chunks.where("label IS NOT NULL"), ["k", "label"], "left_anti").join(chunks.where("label IS NULL").select("k", "chunks"), "k")
    rest = rest.withColumns({"pure": F.lit(None).cast("long"), "no": F.pmod(F.xxhash64("label"), F.col("chunks"))}).drop("chunks")
    meets = F.filter("all", lambda q: q["label"].isNull() | F.col("pure").isNull() | (q["label"] != F.col("pure")))
    dealt = own.unionByName(rest).join(lists, "k").withColumn("q", F.explode(meets))
    name = lambda label, no: F.xxhash64(label, F.col(no).cast("long"))
    sides = F.array_sort(F.array(name("pure", "no"), name("q.label", "q.no")))
    dealt = dealt.withColumns({"i": sides[0], "j": sides[1]}).select("k", "i", "j", "v", "x", "label", F.lit(False).alias("hub"))
    found.append(links_of(_compared(dealt, compare)))
    return so_far.unionByName(found[-1])


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``links(a, b)``: the smallest vertex it reaches.

    Each round lets every vertex follow the neighbour (or itself) that comes first in an order drawn by hash, and joins the
    links of what came together, so links get fewer by a factor from round to round. Then the steps of all rounds are put
    together, from the last one back. Rounds are written to the shared folder.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = common.materialize(pairs, "links")
    first = lambda c: F.struct(F.xxhash64(F.lit("order"), c).alias("h"), F.col(c).alias("r"))
    steps = []
    while not pairs.isEmpty():
        both = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("u")))
        step = both.groupBy("v").agg(F.min(first("u")).alias("near")).select("v", F.least("near", first("v"))["r"].alias("r"))
        steps.append(common.materialize(step, "step"))
        at = [steps[-1].select(F.col("v").alias(c), F.col("r").alias(f"r{c}")) for c in "ab"]
        joined = pairs.join(at[0], "a").join(at[1], "b").where("ra <> rb")
        less = common.materialize(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        common.discard(pairs)
        pairs = less
    if not steps:
        return pairs.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    whole = steps[-1]
    for step in reversed(steps[:-1]):
        after = whole.select(F.col("v").alias("r"), F.col("r").alias("rr"))
        whole = common.materialize(step.join(after, "r", "left").select("v", F.coalesce("rr", "r").alias("r")), "step")
    low = whole.groupBy("r").agg(F.min("v").alias("component"))
    return whole.join(low, "r").select(F.col("v").alias("vertex"), "component")


def group_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, t, fp) for each row of ``docs``, ``t`` a hash of its text; and (fp, id, root) for each fingerprint.

    A group is a set of fingerprints, named ``root`` by the smallest of them: ids may clash, so the smallest id is only its label.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    prints = common.materialize(with_fingerprint(rows).select("id", "t", "fp"), "prints")
    classes = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"))
    classes = common.materialize(classes.select(F.col("fp").alias("vertex"), "fp", "id"), "classes")
    comps = components(class_links(classes))
    return prints, classes.join(comps, "vertex", "left").select("fp", "id", F.coalesce("component", "vertex").alias("root"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``."""
    prints, named = group_rows(docs, id_col, text_col)
    label = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.select("fp", "root").join(label, "root")
    return prints.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id. Rows without id stay."""
    prints, named = group_rows(docs, id_col, text_col)
    first = prints.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "t")).alias("row"))
    kept = first.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.id", "row.t")
    return _rows_of(docs, prints, kept, id_col, text_col)


def shingle_set(text) -> np.ndarray:
    """The distinct hashes of the five-word shingles of one text, in order."""
    return np.unique(np.array(shingle_hashes(text, NEAR_SHINGLE), np.uint64))


def near_print(shingles: np.ndarray) -> bytes | None:
    """The SimHash of a set of shingle hashes, ``PRINT_BITS`` wide: its first 64 bits are those of the hashes, the others of mixes of them."""
    if not len(shingles):
        return None
    total, step = np.zeros(PRINT_BITS, np.int64), np.arange(PRINT_BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 16_384):  # bits of a very long text are summed piece by piece
        h = shingles[at : at + 16_384, None] + step[None, :]
        mixed = h[:, 1:]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[:, 1:] = mixed ^ (mixed >> np.uint64(31))
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(shingles)).tobytes()


def near_masks(n_classes: int) -> tuple[int, list[list[int]]]:
    """Masks as lists of bits, and how many of them suffice for sets of ``SHORT`` shingles or more.

    Mean groups have 16 * sqrt(n) members, so masks stay few: a member costs a row for each of them, a comparison far less.
    """
    width = max(0, math.ceil(math.log2(max(n_classes, 1) ** 0.5 / 16)))
    if not width:
        return 1, [[]]
    agree = np.array([math.comb(PRINT_BITS - d, width) / math.comb(PRINT_BITS, width) for d in range(PRINT_BITS + 1)])

    def needed(share: float) -> int:
        odds = np.array([math.comb(PRINT_BITS, d) * share**d * (1 - share) ** (PRINT_BITS - d) for d in range(PRINT_BITS + 1)])
        return next(m for m in itertools.count(1) if (odds * (1 - agree) ** m).sum() <= MISS)

    similar = NEAR[0] / NEAR[1]
    usual, short = needed(math.acos(2 * similar / (1 + similar)) / math.pi), needed(SHORT_SHARE)
    draw, found = random.Random(SEED), []
    while len(found) < short:  # masks of one round share no bit
        order = draw.sample(range(PRINT_BITS), PRINT_BITS)
        found += [order[at : at + width] for at in range(0, PRINT_BITS - width + 1, width)]
    return usual, found[:short]


def print_pairs(members: np.ndarray, known: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs that span the linked sets of ``members``, rows of a set's size and the words of its print.

    Two link if at most ``NEAR_RADIUS`` bits differ and their sizes allow a similarity of ``NEAR``. ``known`` and ``first`` are those of ``near_pairs``.
    """
    n, size, prints = len(members), members[:, 0].astype(np.int64), np.ascontiguousarray(members[:, 1:])
    label, out = np.unique(np.arange(n) if known is None else known, return_inverse=True)[1], []

    def link(i: int, others: np.ndarray) -> None:
        others = others[label[others] != label[i]]
        others = others[NEAR[1] * np.minimum(size[others], size[i]) >= NEAR[0] * np.maximum(size[others], size[i])]
        if len(others):
            sets, at = np.unique(label[others], return_index=True)
            out.extend((min(i, j), max(i, j)) for j in others[at].tolist())
            joined = np.zeros(n, bool)
            joined[sets] = True
            label[joined[label]] = label[i]

    def apart(i: int) -> np.ndarray:
        return np.bitwise_count(prints ^ prints[i]).sum(1, dtype=np.int16)

    if first is not None:
        for i in range(min(first, n)):
            link(i, np.flatnonzero(apart(i) <= NEAR_RADIUS))
        return out
    # Pivots: the first print, and then the one farthest from all pivots so far.
    tables, nearest, pivot = [], np.full(n, PRINT_BITS + 1, np.int16), 0
    while len(tables) < min(NEAR_PIVOTS, n - 1) and nearest[pivot] > 0:
        tables.append(apart(pivot))
        link(pivot, np.flatnonzero(tables[-1] <= NEAR_RADIUS))
        nearest = np.minimum(nearest, tables[-1])
        nearest[pivot] = 0
        pivot = int(nearest.argmax())
    tables = [t for t in tables if t.max() - t.min() > NEAR_RADIUS]  # others discard nothing
    # Sizes of linked sets are in one stripe or in neighbours; in a stripe rows are in the order of a pivot's table, so neighbours are discarded together.
    stripe = np.floor(np.log(size) / math.log(NEAR[1] / NEAR[0])).astype(np.int64)
    order = np.lexsort((tables[0] if tables else label, stripe))
    stop = np.searchsorted(stripe[order], stripe[order] + 1, side="right")
    for at in range(0, n, 64):
        rows = order[at : at + 64]
        others = order[at : stop[min(at + 64, n) - 1]]
        if (label[rows] == label[rows[0]]).all():
            others = others[label[others] != label[rows[0]]]
        for table in tables:
            others = others[(table[others] >= table[rows].min() - NEAR_RADIUS) & (table[others] <= table[rows].max() + NEAR_RADIUS)]
        for some in np.array_split(others, len(others) // 4096 + 1):
            differ = np.zeros((len(rows), len(some)), np.uint16)
            for word in range(prints.shape[1]):
                differ += np.bitwise_count(prints[rows, word][:, None] ^ prints[some, word][None, :])
            hits = differ <= NEAR_RADIUS
            for k in np.flatnonzero(hits.sum(1)).tolist():
                link(int(rows[k]), some[hits[k]])
    return out


def packed_print_pairs(members: list[bytes], known: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
    return print_pairs(np.frombuffer(b"".join(members), np.uint64).reshape(len(members), -1), known, first)


def packed_print_middle(members: list[bytes]) -> int:
    return fp_middle([m[8:] for m in members])


def print_links(classes: DataFrame, limit: int | None = None) -> DataFrame:
    """Links (a, b) that span the sets of ``classes(cls, size, print)`` with prints within ``NEAR_RADIUS`` that agree on a mask.

    Groups above ``limit`` members aren't held whole, but linked by ``link_groups``.
    """
    spark = classes.sparkSession
    n = classes.count()
    usual, chosen = near_masks(n)
    width, wide = len(chosen[0]), 2 + PRINT_BITS // 64
    limit = limit or max(16 * CHUNK, 4 * n >> width)

    def deal(batches):
        """For each mask and key the members of a batch, as words: class, size, print."""
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None] for k in range(2)]
            rows, bits = np.hstack([*ids, prints.view(np.uint64)]), np.unpackbits(prints, axis=1).astype(np.int64)
            keys, packed = [], []
            for m, mask in enumerate(chosen):
                own = np.arange(len(rows)) if m < usual else np.flatnonzero(rows[:, 1] < SHORT)
                key = (m << width) + bits[np.ix_(own, mask)] @ (1 << np.arange(width, dtype=np.int64))
                order = np.argsort(key, kind="stable")
                start = np.flatnonzero(np.diff(key[order], prepend=-1))
                keys += key[order][start].tolist()
                packed += [rows[part].tobytes() for part in np.split(own[order], start[1:])] if len(start) else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "members"])

    dealt = classes.select("cls", "size", "print").mapInArrow(deal, "key long, members binary")
    sizes = dealt.groupBy("key").agg(F.sum(F.length("members")).alias("n"))
    large = common.materialize(sizes.where(F.col("n") > 8 * wide * limit).select("key"), "large")
    small = dealt if large.isEmpty() else dealt.join(large, "key", "left_anti")
    small = small.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")

    def link(batches):
        rows = ((k, x) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, parts in itertools.groupby(rows, key=lambda row: row[0]):
            group = np.frombuffer(b"".join(x for _, x in parts), np.uint64).reshape(-1, wide)
            pairs = np.array(print_pairs(group[:, 1:]), np.int64).reshape(-1, 2)
            cls = group[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls[pairs[:, 0]]), pa.array(cls[pairs[:, 1]])], names=["a", "b"])

    links = small.mapInArrow(link, "a long, b long")
    if large.isEmpty():
        return links

    def unpack(batches):
        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                group = np.frombuffer(packed, np.uint64).reshape(-1, wide)
                arrays = [pa.array([key] * len(group), pa.int64()), pa.array(group[:, 0].astype(np.int64)), pa.array([x.tobytes() for x in group[:, 1:]], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "v", "x"])

    members = common.materialize(dealt.join(large, "key", "left_semi").mapInArrow(unpack, "k long, v long, x binary"), "members")
    return links.unionByName(link_groups(members, packed_print_pairs, packed_print_middle))


def near_pairs(sets: list[np.ndarray], known: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs that span the linked sets of shingle sets, by an exact Jaccard similarity of at least ``NEAR``.

    Sets of equal ``known`` label aren't compared, and with ``first`` only the first so many are, with all others.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    flat, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    label, out, held = np.unique(np.arange(n) if known is None else known, return_inverse=True)[1], [], np.zeros(len(flat), bool)

    def shared(i: int, others: np.ndarray) -> np.ndarray:
        """Shingles that set ``i`` has in common with each of ``others`` (all of them, or some)."""
        held[place[starts[i] : starts[i] + size[i]]] = True
        if len(others) == n:
            got = np.add.reduceat(held[place], starts, dtype=np.int64)
        else:
            ends = np.cumsum(size[others])
            at = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - size[others]), size[others])
            got = np.add.reduceat(held[place[at]], ends - size[others], dtype=np.int64)
        held[place[starts[i] : starts[i] + size[i]]] = False
        return got

    def link(i: int, others: np.ndarray, both: np.ndarray) -> None:
        union = size[i] + size[others] - both
        for j in others[NEAR[1] * both >= NEAR[0] * union].tolist():
            if label[i] != label[j]:
                out.append((min(i, j), max(i, j)))
                label[label == label[j]] = label[i]

    everyone, table, nearest, pivot = np.arange(n), [], np.full(n, 2.0), 0
    if first is not None:
        for i in range(min(first, n)):
            link(i, everyone, shared(i, everyone))
        return out
    # Pivots: the first set, and then the one farthest from all pivots so far.
    while len(table) < min(NEAR_PIVOTS, n - 1) and nearest[pivot] > 0:
        both = shared(pivot, everyone)
        link(pivot, everyone, both)
        table.append(1.0 - both / (size[pivot] + size - both))
        nearest = np.minimum(nearest, table[-1])
        nearest[pivot] = 0.0
        pivot = int(nearest.argmax())
    table, reach = np.array(table), 1.0 - NEAR[0] / NEAR[1] + 1e-9
    for i in range(n - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(others):
            others = others[np.abs(table[:, others] - table[:, [i]]).max(0, initial=0.0) <= reach]
        if len(others):
            link(i, others, shared(i, others))
    return out


def set_pairs(sets: list[bytes], known: np.ndarray | None = None, first: int | None = None) -> list[tuple[int, int]]:
    return near_pairs([np.frombuffer(x, np.uint64) for x in sets], known, first)


def set_middle(sets: list[bytes]) -> int:
    """The set nearest to the shingles that half of them have."""
    flat, count = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in sets]), return_counts=True)
    usual = flat[2 * count >= len(sets)]
    both = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), usual, assume_unique=True)) for x in sets])
    return int((both / (np.array([len(x) // 8 for x in sets]) + len(usual) - both)).argmax())


def near_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of ``classes(cls, id, t, size, print)``, one for each shingle set; ``docs(id, t, text)`` has their texts."""
    maybe = components(print_links(classes.where("print IS NOT NULL")))
    members = classes.select("cls", "id", "t").join(maybe, F.col("cls") == F.col("vertex")).select("cls", "id", "t", "component")
    members = common.materialize(members, "members")

    def sets(batches):
        for batch in batches:
            made = [shingle_set(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["cls", "component", "set"])

    found = docs.join(members, ["id", "t"]).select("cls", "component", "text").mapInArrow(sets, "cls long, component long, set binary")
    found = common.materialize(found.groupBy("cls", "component").agg(F.first("set").alias("set")), "sets")
    return link_groups(found.select(F.col("component").alias("k"), F.col("cls").alias("v"), F.col("set").alias("x")), set_pairs, set_middle)


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, t) of each row of ``docs(id, t, text)``; and (cls, id, t, component) of each shingle set: its smallest row, and the group that it is in."""

    def prints(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            cls = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            arrays = [batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([near_print(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "t", "cls", "size", "print"])

    made = docs.where("id is not null").select("id", "t", "text").mapInArrow(prints, "id long, t long, cls long, size long, print binary")
    made = common.materialize(made, "prints")
    classes = made.groupBy("cls").agg(F.min(F.struct("id", "t")).alias("row"), F.first("size").alias("size"), F.first("print").alias("print"))
    classes = common.materialize(classes.select("cls", "row.id", "row.t", "size", "print"), "classes")
    comps = components(near_links(classes, docs))
    named = classes.join(comps, F.col("cls") == F.col("vertex"), "left").select("cls", "id", "t", F.coalesce("component", "cls").alias("component"))
    return made.select("id", "t"), named


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of texts linked by ``NEAR``: that with the smallest id. Rows without id stay."""
    key, t = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rows, found = near_classes(docs.select(key.alias("id"), t.alias("t"), F.col(text_col).alias("text")))
    kept = found.groupBy("component").agg(F.min(F.struct("id", "t")).alias("row")).select("row.id", "row.t")
    return _rows_of(docs, rows, kept, id_col, text_col)


def _rows_of(docs: DataFrame, rows: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each (id, hash of the text) in ``kept(id, t)``, and all rows without id. ``rows`` has id and t of all."""
    at_id, at_t = common.free_name(docs, "_kept_id"), common.free_name(docs, "_kept_t")
    many = rows.groupBy("id", "t").count().where("count > 1").select("id", "t", F.lit(True).alias("many"))
    kept = kept.join(many, ["id", "t"], "left").select(F.col("id").alias(at_id), F.col("t").alias(at_t), "many")
    kept = common.materialize(kept, "kept")
    marked = docs.withColumns({at_id: F.col(id_col).cast("long"), at_t: F.xxhash64(text_col)})
    out = marked.join(kept.where("many IS NULL"), [at_id, at_t], "left_semi").select(*docs.columns)
    if not kept.where("many").isEmpty():  # the first of repeated rows by all columns
        row = F.struct(*docs.columns)
        twice = marked.join(kept.where("many"), [at_id, at_t], "left_semi")
        out = out.unionByName(twice.groupBy(at_id, at_t).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprint and group of every document."""
    common.tune(spark)
    found = group(common.read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
