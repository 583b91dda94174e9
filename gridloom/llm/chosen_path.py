"""Near-duplicate documents by a chosen-path set similarity join (operator 5).

A document is the set of its distinct word shingles. In each of ``trees``
independent trees (``TREES``) the root's documents branch to their ``BRANCH``
least tokens under the tree's hash of that level, deeper nodes' to their
``DEEPER`` least. Documents that share such a token meet in a child node. For a
pair of similarity 0.8 the chance that the three least tokens of one and the
other have none in common is about 0.006 a tree, so four trees miss about one
such pair in 10^9; nodes that branch twice more keep such a pair in each tree
with a chance of 0.92 and miss 4 in 10^5. Links are confirmed on full sets.

The work within nodes is kept linear in the rows:

* Equal sets are one class and enter the trees once, as their smallest doc_id.
* Every node first ties all its members to one pivot (a star); stars that their
  sketches refuse are left to the later steps, the others are confirmed on full
  sets and joined to components. Of what remains, only pairs *between different
  components* can change the result, so a node whose members are all in one
  component is finished.
* An unfinished node of at most ``small`` members is compared exhaustively. A
  larger one branches again, up to three levels.
* What is still large at the last level is compared exactly too, on full sets and
  in blocks of a bounded number of members: all members outside the largest
  component against all members. No cap, no sampling.

Defined cases: null or wordless text has an empty set, links with nothing and
is its own component; null doc_id rows get a null component and kept = false;
repeated doc_ids count as versions of one document; of equal texts the smallest
doc_id stands for all; a text of any length is taken whole; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import scratch, textbytes
from gridloom.llm.components import components

TREES, LEVELS, BRANCH, DEEPER, SKETCH, BLOCK_SHINGLES = 4, 3, 3, 2, 64, 1 << 19
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data, offs, width: int):
    """Sorted distinct shingle hashes of each row of a block, flat, with row offsets."""
    starts, ends, at = textbytes.word_spans(data, offs)
    words = textbytes.word_hashes(data, starts, ends)
    n_words = np.diff(at)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(n)), n)
    to = np.concatenate(([0], np.cumsum(n)))
    first = at[:-1][row] + (np.arange(to[-1]) - to[:-1][row])
    size = np.minimum(n_words[row], width)
    shingles = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, m in enumerate(textbytes.odd(width, 11)):
        got = words[np.minimum(first + k, len(words) - 1)] if len(words) else words
        shingles += np.where(k < size, got * m, np.uint64(0))
    shingles = textbytes.mix(shingles)
    for a, b in zip(to[:-1], to[1:]):
        shingles[a:b].sort()
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    return shingles[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n)))))


def _least(values: np.ndarray, to: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` least values of each row (rows by count), all ones where it has fewer."""
    out = np.full((len(to) - 1, count), _TOP, dtype=np.uint64)
    full = np.flatnonzero(to[1:] > to[:-1])
    if len(full) == 0:
        return out
    lens = (to[1:] - to[:-1])[full]
    for k in range(count):
        low = np.minimum.reduceat(values, to[:-1][full])
        out[full, k] = low
        if k + 1 < count:
            values[values == np.repeat(low, lens)] = _TOP
    return out


def _profile(width: int):
    multipliers = textbytes.odd(TREES * LEVELS, 77)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for r0, r1, data, offs in textbytes.blocks(texts):
                flat, to = shingle_sets(data, offs, width)
                n = np.diff(to)
                sums = []
                for seed in (3, 5):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textbytes.mix(flat * textbytes.odd(1, seed)[0]))))
                    sums.append((total[to[1:]] - total[to[:-1]]).view(np.int64))
                tokens = []
                for level in range(LEVELS):
                    trees = [_least(flat * multipliers[level * TREES + t], to, BRANCH) for t in range(TREES)]
                    tokens.append(np.concatenate(trees, axis=1))
                take = np.minimum(n, SKETCH)
                sk_to = np.concatenate(([0], np.cumsum(take)))
                at = np.repeat(to[:-1] - sk_to[:-1], take) + np.arange(sk_to[-1])
                sketch = pa.ListArray.from_arrays(pa.array(sk_to, pa.int32()), pa.array((flat[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * t.shape[1], pa.int32()), pa.array(t.reshape(-1).view(np.int64))) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(r0, r1 - r0), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), sketch, *lists],
                    names=["doc_id", "n", "hi", "lo", "sketch", *(f"t{k + 1}" for k in range(LEVELS))],
                )

    return textbytes.lean(run)


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _sets(width: int, bits):
    def run(batches):
        held = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array((held[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)))
            for r0, r1, data, offs in textbytes.blocks(some.column(1)):
                flat, to = shingle_sets(data, offs, width)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).slice(r0, r1 - r0), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(flat.view(np.int64)))], names=["id", "s"]
                )

    return textbytes.lean(run)


def _sets_of(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, s): the full sets of the documents with the ``wanted`` ids.

    Texts are not shuffled: a bit map of about 16 bits an id (128 kB to 16 MB) is
    broadcast, sets are made where its bits are set, and the exact ids are joined
    afterwards. Past some 30 million ids, where such a map lets too much through,
    the ids are joined to the texts before it as well.
    """
    spark = docs.sparkSession
    wanted = scratch.keep(wanted, "wanted")
    count = wanted.count()
    size = min(max(1 << (16 * count).bit_length(), LEAST_BITS), MOST_BITS)
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    # cells count from 1 in Spark's bit maps: bucket b, position p hold cell (b - 1) * 32768 + p, counted from 0
    where = wanted.select((cell + 1).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("m"))
    bits = bytearray(size // 8)
    for r in where.toLocalIterator():  # at most size / 32768 rows of 4 kB
        at = (r.k - 1) * 4096
        bits[at : at + 4096] = r.m
    sent = spark.sparkContext.broadcast(bytes(bits))
    rows = docs.where("doc_id is not null").select("doc_id", "text", cell.alias("cell"))
    if 4 * count > size:
        rows = rows.join(wanted, "doc_id", "left_semi")
    return rows.mapInArrow(_sets(width, sent), "id long, s array<long>").join(wanted.withColumnRenamed("doc_id", "id"), "id", "left_semi")


def _near_sizes(x: Column, y: Column, num: int, den: int) -> Column:
    return F.least(x, y) * den >= F.greatest(x, y) * num


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of class representatives that are similar: sketches first, then full sets."""
    s = reps.select("id", "n", "sketch")
    both = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    close = F.when(whole, common * den >= (F.col("na") + F.col("nb") - common) * num).otherwise(common * den * 4 >= F.least("na", "nb", F.lit(SKETCH)) * num * 3)
    likely = both.where(_near_sizes(F.col("na"), F.col("nb"), num, den) & close).select("a", "b")
    likely = scratch.keep(likely, "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = scratch.keep(_sets_of(wanted, docs, width), "sets")
    full = likely.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    found = scratch.keep(full.where(common * den >= (F.size("sa") + F.size("sb") - common) * num).select("a", "b"), "links")
    scratch.drop(likely, sets)
    return found


def _parts(count: Column, shingles: Column, block: int) -> Column:
    """The number of parts that keeps one to about ``block`` sets and ``BLOCK_SHINGLES`` shingles (4 MB)."""
    return F.greatest(F.ceil(count / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _confirmed_in_blocks(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """As :func:`_confirmed`, for pairs that lie thick: each set is sent once to a block of pairs, not once a pair.

    A document's block is led by the least of its partners, so families fall together;
    large families are cut into parts, by the number and the summed size of their sets.
    """
    pairs = scratch.keep(pairs, "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("k")).join(reps.select(F.col("id").alias("a"), "n"), "a")
    sizes = lead.groupBy("k").agg(_parts(F.count("*"), F.sum("n"), block).alias("parts"))
    lead = lead.join(sizes, "k").select(F.col("a").alias("id"), F.struct("k", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("p")).alias("g"))
    lead = scratch.keep(lead, "lead")
    routed = pairs.join(lead.toDF("a", "ga"), "a").join(lead.toDF("b", "gb"), "b")
    routed = scratch.keep(routed, "routed")
    keys = ["ga", "gb"]
    sets = _sets_of(lead.select(F.col("id").alias("doc_id")), docs, width)
    sent = routed.select(*keys, F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")
    sent = sent.groupBy(*keys).agg(F.collect_list(F.struct("id", "s")).alias("sets"))
    lists = routed.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("ps"))
    found = scratch.keep(sent.join(lists, keys).select("sets", "ps").mapInArrow(textbytes.lean(_check_block(num, den)), "a long, b long"), "links")
    scratch.drop(pairs, lead, routed)
    return found


def _check_block(num: int, den: int):
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                sets: dict[int, list] = {}
                for x in batch.column(0)[k].values if batch.column(0)[k].values is not None else ():
                    sets.setdefault(x["id"].as_py(), []).append(x["s"].values.to_numpy().view(np.uint64))
                ps = batch.column(1)[k].values
                a, b = ps.field("a").to_pylist(), ps.field("b").to_pylist()
                good_a, good_b, last, mine = [], [], None, []
                for x, y in sorted(zip(a, b)):
                    if x != last:
                        last, mine = x, sets[x]
                    for s in mine:
                        for t in sets[y]:
                            if min(len(s), len(t)) * den < max(len(s), len(t)) * num:
                                continue
                            at = np.searchsorted(t, s)
                            at[at == len(t)] = 0
                            common = int(np.count_nonzero(t[at] == s))
                            if common * den >= (len(s) + len(t) - common) * num:
                                good_a.append(x)
                                good_b.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], names=["a", "b"])

    return run


def _cross_pairs(members: str) -> Column:
    """All pairs of a small node's members that are in different components and near in size."""
    return F.expr(
        f"flatten(transform({members}, (x, i) -> transform(filter(slice({members}, i + 2, size({members})), "
        "y -> y.c <> x.c and least(x.n, y.n) * _den >= greatest(x.n, y.n) * _num), y -> struct(least(x.id, y.id) as a, greatest(x.id, y.id) as b))))"
    )


def _members_of(cell):
    """ids, components and flat sets (with offsets) of a list of (id, c, s)."""
    rows = cell.values
    sets = rows.field("s")
    to = sets.offsets.to_numpy().astype(np.int64)
    return rows.field("id").to_numpy(), rows.field("c").to_numpy(), sets.values.to_numpy().view(np.uint64)[to[0] : to[-1]], to - to[0]


def _compared(num: int, den: int):
    """Exhaustive comparison of two blocks of a family on full sets; gives links that join components, no more."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                xs, cx, sx, tx = _members_of(batch.column(0)[k])
                ys, cy, sy, ty = _members_of(batch.column(1)[k])
                n = np.diff(ty)
                order = np.argsort(sy, kind="stable")
                keys, owner = sy[order], np.repeat(np.arange(len(ys)), n)[order]
                root: dict[int, int] = {}

                def find(v: int) -> int:
                    while root.get(v, v) != v:
                        v = root[v]
                    return v

                a, b = [], []
                for i in range(len(xs)):
                    mine = sx[tx[i] : tx[i + 1]]
                    lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                    hits = hi - lo
                    ends = np.cumsum(hits)
                    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + hits, hits)
                    common = np.bincount(owner[at], minlength=len(ys))
                    good = np.flatnonzero((cy != cx[i]) & (common * den >= (n + len(mine) - common) * num))
                    for j in good:
                        p, q = find(int(cx[i])), find(int(cy[j]))
                        if p != q:
                            root[p] = q
                            a.append(int(xs[i]))
                            b.append(int(ys[j]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _leaf_links(rest: DataFrame, reps: DataFrame, docs: DataFrame, width: int, block: int, num: int, den: int) -> DataFrame:
    """Links between components among the members of leaves that stay large.

    Leaves that share members are one family, so a document is compared in one place
    only. In a family all members outside its largest component are compared with all
    members, block by block.
    """
    heads = rest.groupBy("node").agg(F.min("id").alias("a"))
    families = components(rest.join(heads, "node").select("a", F.col("id").alias("b")))
    members = rest.select("id", "n", "c").distinct().join(families.select(F.col("v").alias("id"), F.col("component").alias("f")), "id")
    members = scratch.keep(members, "members")
    sizes = members.groupBy("f", "c").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
    tops = sizes.groupBy("f").agg(F.max_by("c", F.struct("count", "c")).alias("top"), _parts(F.sum("count"), F.sum("shingles"), block).alias("parts"))
    sets = _sets_of(members.select(F.col("id").alias("doc_id")).distinct(), docs, width)
    full = scratch.keep(members.join(tops, "f").join(sets, "id"), "leaf-sets")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    body = F.struct("id", "c", "s")
    ys = full.select("f", part.alias("py"), every.alias("px"), body.alias("y"))
    xs = full.where("c <> top").select("f", part.alias("px"), every.alias("py"), body.alias("x"))
    keys = ["f", "px", "py"]
    both = xs.groupBy(keys).agg(F.collect_list("x").alias("xs")).join(ys.groupBy(keys).agg(F.collect_list("y").alias("ys")), keys)
    found = scratch.keep(both.select("xs", "ys").mapInArrow(textbytes.lean(_compared(num, den)), "a long, b long"), "links")
    scratch.drop(members, full)
    return found


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5, small: int = 32, block: int = 256) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs(doc_id, text)``.

    Documents are linked when the Jaccard similarity of their sets of ``width``-word
    shingles is num/den or more; component_id is the smallest doc_id reachable.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = ", ".join(f"t{k + 1} array<long>" for k in range(LEVELS))
    profiles = scratch.keep(docs.mapInArrow(_profile(width), f"doc_id long, n long, hi long, lo long, sketch array<int>, {lists}"), "profiles")
    known = profiles.where("n > 0 and doc_id is not null")
    reps = known.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "n", "sketch", *(f"t{k + 1}" for k in range(LEVELS)))).alias("r"))
    reps = scratch.keep(reps.select("hi", "lo", F.col("r.doc_id").alias("id"), *(f"r.{c}" for c in ("n", "sketch", *(f"t{k + 1}" for k in range(LEVELS))))), "reps")

    def children(nodes: DataFrame | None, level: int) -> DataFrame:
        """(node, tree, id, n): the members' least tokens lead from their node to its children."""
        tokens = f"t{level}"
        if nodes is None:
            base = reps.select("id", "n", F.posexplode(tokens).alias("p", "token")).withColumn("node", F.lit(0)).withColumn("tree", F.floor(F.col("p") / BRANCH).cast("int"))
        else:
            own = reps.select("id", tokens)
            base = nodes.join(own, "id").select("id", "n", "node", "tree", F.explode(F.slice(tokens, F.col("tree") * BRANCH + 1, DEEPER)).alias("token"))
        return base.where("token <> -1").select(F.xxhash64("node", "tree", "token").alias("node"), "tree", "id", "n").distinct()

    first = scratch.keep(children(None, 1), "nodes")
    pivots = first.groupBy("node").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("node", "a")
    stars = first.join(pivots, "node").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = _confirmed(stars, reps, docs, width, num, den)
    tied = scratch.keep(components(links), "tied")

    rest, pairs, passed = first, None, [first]
    for level in range(1, LEVELS + 1):
        named = rest.join(tied.select(F.col("v").alias("id"), F.col("component").alias("c0")), "id", "left").select("node", "tree", "id", "n", F.coalesce("c0", "id").alias("c"))
        named = scratch.keep(named, "named")
        open_ = named.groupBy("node").agg(F.count("*").alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("node", "m")
        few = named.join(open_.where(F.col("m") <= small), "node", "left_semi")
        lists_ = few.groupBy("node").agg(F.collect_list(F.struct("id", "n", "c")).alias("ms")).withColumns({"_num": F.lit(num), "_den": F.lit(den)})
        found = lists_.select(F.explode(_cross_pairs("ms")).alias("p")).select("p.a", "p.b")
        pairs = found if pairs is None else pairs.unionByName(found)
        many = named.join(open_.where(F.col("m") > small), "node", "left_semi")
        rest = scratch.keep(many if level == LEVELS else children(many, level + 1), "rest")
        passed += [named, rest]
        if rest.isEmpty():
            break
    more = _confirmed_in_blocks(pairs.distinct(), reps, docs, width, num, den, block)
    if not rest.isEmpty():
        more = more.unionByName(_leaf_links(rest, reps, docs, width, 4 * block, num, den))
    scratch.drop(*passed)
    if not more.isEmpty():
        tied = components(links.unionByName(more))
    classes = reps.join(tied.select(F.col("v").alias("id"), "component"), "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("c"))
    out = profiles.join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("c"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id; its columns stay.

    Rows with a null doc_id stay; of rows that repeat a kept doc_id all stay.
    """
    gone = near_duplicates(docs, **options).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
