"""Near-duplicates by BagMinHash: weighted Jaccard of multisets of five-word shingles, 0.8 and more.

Every shingle with its count is a weight. Weights lie on the levels 0-1, 1-2, 2-4, 4-8, ...: each
level of each shingle is a Poisson process of its own, seeded by shingle and level, whose rate is
the level's width; a point's position within the level tells whether it counts for a weight that
ends inside the level, and its register is uniform. A register keeps its first point, so two
documents agree in a register with the probability of their weighted Jaccard. Points are drawn
up to the time by which all registers are filled, which makes the effort independent of counts.

Steps: equal texts become one (by 128 bits of hash) and get a number; signatures are cut into
bands, and bands are buckets. Only buckets with several texts go on, and only their texts are
read again, once, for the exact multisets. In rounds, every member of a bucket is paired with the
bucket's leader, unless both are in one component already; pairs whose numbers of shingles or
whose registers (two bits of each) rule out 0.8 are never made, the others are verified by exact
multiset overlap, and links are contracted to components. A leader has then met all members and
leaves, so a bucket of two is done after a round, of three after two. Members of what is still
unsettled after ROUNDS are compared exactly, by a prefix filter: shingles are put in one order,
those of a single component first, then rare ones, and alike texts share one among the first fifth
of either. Shingles of many members are joined in salted blocks. No step lists all pairs of a
bucket, and no bucket is held in one place.

Defined results: words are runs of characters other than white space; texts of one to four words
have one shingle; null and empty texts are equal texts and alike to nothing else; the class id is
the smallest doc_id of the class, null if none of its rows has an id; rows that share an id but
not a text are rows of their own; repeated rows are in one class; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanframe.llm.common import discard, materialize, text_or_empty, utf8_list

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band in 3 of a million cases
REGISTERS = BANDS * ROWS
ROUNDS = 3  # of leaders
SKETCH = 3  # 64-bit numbers that hold two bits of each register
BLOCK = 2048  # members with a shingle that one task compares with all others; a member is sent to one task for each so many

GOLD, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
WHEEL = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """A 64-bit hash of each shingle, in order."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    size = min(SHINGLE, len(w))
    out = w[: len(w) - size + 1] + np.uint64(size)
    for k in range(1, size):
        out = out * WHEEL + w[k : len(w) - size + 1 + k]
    return mix(out)


def _fewest_agreeing(loss: float = 1e-6) -> int:
    """The number of registers that fewer agree in only with probability `loss`, at SIMILARITY and two bits each."""
    p = SIMILARITY + (1 - SIMILARITY) / 4
    below, k = 0.0, 0
    while (below := below + math.comb(REGISTERS, k) * p**k * (1 - p) ** (REGISTERS - k)) < loss:
        k += 1
    return k


AGREEING = _fewest_agreeing()


def _points(seed: np.ndarray, rate: float, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Process number, time and hash of all points of the processes up to their times."""
    found, at, start, drawn = [], np.arange(len(seed)), np.zeros(len(seed)), 0
    while len(at):
        # So many in a row that most processes are over, without a large matrix.
        k = max(1, min(1 + int(float(np.median(until[at] - start)) * rate), 1 + (1 << 18) // len(at)))
        x = mix(seed[at, None] + np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * GOLD)
        t = start[:, None] + np.cumsum(-np.log(((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53), 1) / rate
        good = t <= until[at, None]
        row, col = np.nonzero(good)
        found.append((at[row], t[row, col], x[row, col]))
        more = good[:, -1]
        at, start, drawn = at[more], t[more, -1], drawn + k
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def signatures(items: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int, slack: float = 3.0) -> np.ndarray:
    """One 32-bit number for each document and register, of items with integer weights of 1 and more.

    doc: the documents that the items belong to, numbered from 0; none of them without an item.
    """
    until = REGISTERS * (math.log(REGISTERS) + slack) / np.bincount(doc, counts, docs)
    first = np.full(docs * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    low, width, level = 0, 1, 0
    while (has := np.flatnonzero(counts > low)).size:
        seed = mix(items[has] + WHEEL * np.array(level + 1, np.uint64))
        of, t, x = _points(seed, float(width), until[doc[has]])
        y, of = mix(x ^ seed[of]), has[of]
        if width > 1:  # the point's place within the level, against weights that end inside it
            inside = low + ((y & np.uint64(0xFFFF)).astype(np.float64) * (width / 65536.0)) < counts[of]
            t, y, of = t[inside], y[inside], of[inside]
        register = ((y >> np.uint64(48)) * np.uint64(REGISTERS) >> np.uint64(16)).astype(np.int64)
        # Time above, the point's number below: the least is the first point.
        point = t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | mix(y + GOLD) >> np.uint64(32)
        np.minimum.at(first, doc[of] * REGISTERS + register, point)
        low, width, level = (1, 1, 1) if level == 0 else (low + width, 2 * width, level + 1)
    out = first.reshape(docs, REGISTERS)
    short = np.flatnonzero((out == np.iinfo(np.uint64).max).any(1))
    out = out.astype(np.uint32)  # the lower half
    if len(short):
        again = np.full(docs, -1)
        again[short] = np.arange(len(short))
        part = again[doc] >= 0
        out[short] = signatures(items[part], counts[part], again[doc[part]], len(short), slack + 5)
    return out


def bands(texts: list[bytes]) -> list[np.ndarray]:
    """The bucket of each band of each text, its number of shingles, and its sketch (nothing for a text without words)."""
    out = [np.zeros(0, np.int64)] * len(texts)
    bags, at, size = [], [], 0
    for n, text in enumerate(texts):
        bag = shingles(text)
        bag.sort()
        if len(bag):
            bags.append(bag)
            at.append(n)
            size += len(bag)
        if bags and (size > 1 << 15 or n + 1 == len(texts)):
            every, doc = np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            new = np.concatenate([[True], (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])]).nonzero()[0]
            sig = signatures(every[new], np.diff(np.append(new, len(every))), doc[new], len(bags)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, (len(bags), 1))
            for k in range(ROWS):
                key = mix(key + sig[:, :, k])
            low = (sig.reshape(len(bags), SKETCH, 32) & np.uint64(3)) << np.arange(0, 64, 2, dtype=np.uint64)
            sketch = np.bitwise_or.reduce(low, 2).view(np.int64)
            for n_of, row, bag, own in zip(at, key.view(np.int64), bags, sketch, strict=True):
                out[n_of] = np.concatenate([row, [len(bag)], own])
            bags, at, size = [], [], 0
    return out


def overlap_codes(text: bytes) -> np.ndarray:
    """The multiset as a set: each shingle with the number of its occurrence."""
    items, counts = np.unique(shingles(text), return_counts=True)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(items, counts) + nth.astype(np.uint64) * WHEEL).view(np.int64)


def _of_texts(docs: DataFrame, make, name: str) -> DataFrame:
    """All columns but the last, which is the text, and what make(texts) gives, under a name."""
    keep = docs.columns[:-1]
    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes[:-1])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                made = pa.array(make(utf8_list(part.column(len(keep)))), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], [*keep, name])

    return docs.mapInArrow(run, f"{schema}, {name} array<long>")


def _verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multiset overlap is SIMILARITY and more. codes: id, codes."""
    both = pairs.join(codes.select(F.col("id").alias("a"), F.col("codes").alias("x")), "a").join(codes.select(F.col("id").alias("b"), F.col("codes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("s")).filter(F.col("c") >= SIMILARITY * (F.col("s") - F.col("c")) - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of all ends of links (a, b) but the least of each component, which is the class id:
    alternating large and small stars, tables between."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = materialize(edges, "edges")
    while True:
        # Stars have no end that is below one end and above another, or above two.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("above"), F.lit(1).alias("below")))).alias("e"))
        if ends.groupBy("e.x").agg(F.sum("e.above").alias("above"), F.max("e.below").alias("below")).filter("above + below > 1 and above > 0").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = materialize(small, "edges")
        discard(edges)
        edges = after
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
    out._written_to = edges._written_to
    return out


def _with_links(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components with more links: those of the components that the links join."""
    if classes is None:
        return components(links)
    side = lambda x: classes.select(F.col("id").alias(x), F.col("class_id").alias(f"class_{x}"))
    known = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    new = components(known.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")))
    moved = classes.join(new.select(F.col("id").alias("class_id"), F.col("class_id").alias("to")), "class_id", "left").select("id", F.coalesce("to", "class_id").alias("class_id"))
    out = materialize(moved.unionByName(new), "components")
    discard(new)
    return out


def _can_be_alike(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether numbers of shingles and sketches allow two texts to be alike."""
    sizes = F.least(x("size"), y("size")) >= SIMILARITY * F.greatest(x("size"), y("size")) - 1e-9
    differ = []
    for k in range(SKETCH):
        d = x(f"s{k}").bitwiseXOR(y(f"s{k}"))
        differ.append(F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    return sizes & F.coalesce(REGISTERS - sum(differ[1:], differ[0]) >= AGREEING, F.lit(True))


OF_TEXT = ["size", *[f"s{k}" for k in range(SKETCH)]]


def _met_leaders(rows: DataFrame, classes: DataFrame | None, of_bucket: bool) -> DataFrame:
    """Rows of buckets with members of different components, their leader, and whether that pair is to be verified.

    rows: bucket, id and OF_TEXT. The first leaders are the first in one order for all buckets, so
    that alike documents have few of them; later ones are first in an order of their bucket.
    """
    known = rows.withColumn("class", F.col("id")) if classes is None else rows.join(classes.select("id", F.col("class_id").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id"))
    order = F.xxhash64("bucket", "id") if of_bucket else F.xxhash64("id")
    first = F.min(F.struct(order.alias("o"), *[F.col(c).alias(f"l_{c}") for c in ("id", "class", *OF_TEXT)])).alias("x")
    leader = known.groupBy("bucket").agg(first, F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("bucket", "x.*").drop("o")
    met = known.join(leader, "bucket").filter(F.col("id") != F.col("l_id"))
    asked = (F.col("class") != F.col("l_class")) & _can_be_alike(F.col, lambda c: F.col(f"l_{c}"))
    return met.select("bucket", "id", *OF_TEXT, F.col("l_id").alias("leader"), asked.alias("asked"))


def _rest_pairs(rows: DataFrame, classes: DataFrame, codes: DataFrame, used: list[DataFrame]) -> DataFrame:
    """All pairs (a, b) of members of different components that can be alike. rows as above; codes: id, codes.

    In any order of shingles, the first that alike texts share leaves enough behind it in both.
    """
    known = rows.join(classes.select("id", F.col("class_id").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("bucket")
    members = materialize(known.join(mixed, "bucket").select("id", "class", *OF_TEXT).dropDuplicates(["id"]), "unsettled")
    used.append(members)
    each = codes.join(members.select("id", "class", "size"), "id").select("id", "class", "size", F.explode("codes").alias("code"))
    # A shingle of one component alone is no part of any overlap here: it takes a place before all others, and no row.
    spread = each.groupBy("code").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("code", "n")
    own = Window.partitionBy("id")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "code")) - 1
    rest = each.join(spread, "code").withColumn("rest", F.col("size") - place).filter(F.col("rest") >= SIMILARITY * F.col("size") - 1e-6)
    prefix = materialize(rest.select("code", "id", "rest").join(members, "id"), "first shingles")
    used.append(prefix)
    blocks = prefix.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("code", "blocks")
    salted = prefix.join(blocks, "code")
    x = salted.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("x")
    y = salted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    enough = (1 + SIMILARITY) * F.least("x.rest", "y.rest") >= SIMILARITY * (F.col("x.size") + F.col("y.size")) - 1e-6
    on = (F.col("x.code") == F.col("y.code")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.class") != F.col("y.class")) & enough & _can_be_alike(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def text_hashes() -> list[Column]:
    """h1, h2: 128 bits that stand for the text."""
    return [F.xxhash64(text_or_empty()).alias("h1"), F.xxhash64(F.lit("second"), text_or_empty()).alias("h2")]


def text_classes(docs: DataFrame) -> DataFrame:
    """A table with a row for each distinct text: h1, h2, doc_id and n_first (the text's smallest id and its
    number of rows with that id), class and class_id (the class's number and smallest id)."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    signed = materialize(_of_texts(docs.select(doc_id, *text_hashes(), "text"), bands, "made"), "signatures")
    by_id = signed.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    first = by_id.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "n")).alias("x")).select("h1", "h2", "x.doc_id", F.col("x.n").alias("n_first"))
    # Written once, numbers stay what they are.
    texts = materialize(first.withColumn("id", F.monotonically_increasing_id()), "texts")
    mine = (F.col("s.h1") == F.col("t.h1")) & (F.col("s.h2") == F.col("t.h2")) & F.col("s.doc_id").eqNullSafe(F.col("t.doc_id"))
    made = signed.alias("s").join(texts.alias("t"), mine).select("t.id", "s.made").dropDuplicates(["id"]).filter(F.size("made") > 0)
    made = materialize(made, "signatures of texts")
    bucketed = made.select("id", F.explode(F.slice("made", 1, BANDS)).alias("bucket"))
    several = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    of_text = made.select("id", *[F.try_element_at("made", F.lit(BANDS + 1 + k)).alias(c) for k, c in enumerate(OF_TEXT)])
    rows = materialize(bucketed.join(several, "bucket", "left_semi").join(of_text, "id"), "bands")
    discard(signed)
    discard(made)

    needed = texts.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("h1").alias("t_h1"), F.col("h2").alias("t_h2"), F.col("doc_id").alias("t_id"))
    same = (F.col("h1") == F.col("t_h1")) & (F.col("h2") == F.col("t_h2")) & F.col("doc_id").eqNullSafe(F.col("t_id"))
    found = docs.select(doc_id, *text_hashes(), "text").join(needed.hint("shuffle_hash"), same).select("id", "text").dropDuplicates(["id"])
    codes = materialize(_of_texts(found, lambda texts: [overlap_codes(t) for t in texts], "codes"), "overlap codes")

    used, checked, classes = [codes], None, None

    def learn(pairs: DataFrame, classes: DataFrame | None) -> DataFrame | None:
        nonlocal checked
        pairs = materialize(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        more = materialize(_verified(pairs, codes), "links")
        used.extend([pairs, more])
        checked = pairs if checked is None else checked.unionByName(pairs)
        if classes is not None and more.isEmpty():
            return classes
        out = _with_links(classes, more)
        used.append(out)
        return out

    for k in range(ROUNDS):
        met = materialize(_met_leaders(rows, classes, k > 0), "met leaders")
        discard(rows)
        rows = met.select("bucket", "id", *OF_TEXT)
        rows._written_to = met._written_to
        classes = learn(met.filter("asked").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), classes)
        if met.isEmpty():
            break
    else:
        classes = learn(_rest_pairs(rows, classes, codes, used), classes)
    used.append(rows)
    members = classes.unionByName(classes.select(F.col("class_id").alias("id"), "class_id").distinct())
    members = materialize(members.join(texts.select("id", "doc_id"), "id"), "members")
    used.append(members)
    smallest = members.groupBy("class_id").agg(F.min("doc_id").alias("smallest"))
    known = texts.join(members.select("id", "class_id").join(smallest, "class_id"), "id", "left")
    out = known.select("h1", "h2", "doc_id", "n_first", F.coalesce("class_id", "id").alias("class"), F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("class_id"))
    out = materialize(out, "text classes")
    for table in [*used, texts]:
        discard(table)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: one row per document; the class id is the smallest doc_id of the class."""
    classes = text_classes(docs).select("h1", "h2", "class_id")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_hashes()).join(classes, ["h1", "h2"]).select("doc_id", "class_id")


def first_of_classes(docs: DataFrame) -> DataFrame:
    """The rows that stay when each class keeps one: a row with the smallest doc_id, of its text, with all columns.

    Rows that repeat that id and text are one; of rows without an id one stays if the class has no other.
    """
    classes = text_classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h1", "h2", "n_first")
    first = classes.groupBy("class").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("f_id"), F.col("x.h1").alias("f_1"), F.col("x.h2").alias("f_2"), F.col("x.n_first").alias("f_n"))
    first = materialize(first, "first of classes")
    discard(classes)
    h1, h2 = text_hashes()
    # Names by place, so that columns of any name pass through.
    names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)]
    rows = docs.toDF(*names)
    same = (h1 == F.col("f_1")) & (h2 == F.col("f_2")) & F.col("doc_id").cast("long").eqNullSafe(F.col("f_id"))
    kept = rows.join(first.hint("shuffle_hash"), same).select(*names, "f_1", "f_2", "f_n")
    # Only what is repeated is grouped, and none of the other texts is sorted.
    once, again = kept.filter("f_n = 1"), kept.filter("f_n > 1").dropDuplicates(["f_1", "f_2"])
    return once.unionByName(again).select(*names).toDF(*docs.columns)
