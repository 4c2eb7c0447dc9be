"""Jaccard join of documents on word shingles, size-aware (heavy and light).

Sets are joined at a Jaccard similarity of 0.8 or more. Documents of one set
form a class and only classes are joined. Shingles are ranked by the number
of classes that hold them, rarest first; two similar sets of sizes n and m share
at least ``o = ceil(4/9 (n + m))`` shingles, so they share one of the first
``n - o + 1`` of each, and two of the first ``n - o + 2``.

First the members of each inverted list of the shorter prefix are compared with
one of them, that shares most of its shingles. Most lists are then one component
and can connect nothing more. Of the others, the open ones, the sets meet by size:

* **Light** (small) sets enumerate all 2-subsets of the longer prefix's open
  shingles; two light sets meet where they have a subset in common, so a shingle
  that many hold brings nobody together.
* **Heavy** (large) sets would enumerate too many; they scan the inverted lists
  of the shorter prefix, which light sets near the boundary join too.

The boundary is the size at which enumerating and scanning cost least in sum.
Shingles of one class only are never sent: they cannot be shared. Two similar sets
of different components share open shingles only, so none is missed.

No list is paired up. One that holds several components belongs to the one with
most of its members, and the classes of all lists of one owner are gathered once
each, however many lists they meet in. They are compared there wherever their
components differ, which covers every pair of every open list, so no link between
components is lost; one link of two components leaves.

The links themselves all lie inside components and are counted or listed there.
Both comparisons deal a group's classes over cells of bounded size, by size band
and hash, and every two cells that can hold a link count the shingles of all
their pairs as a matrix product. No pair becomes a row unless pairs are asked
for; comparisons grow with the square of a component or of an owner's group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import exchange as X
from lopside.llm import kernel
from lopside.llm.components import connected_components
from lopside.session import materialize

U64 = np.uint64
CELL_CLASSES, CELL_BYTES = 512, 4 << 20  # of one cell of a component
COLUMNS = 4096  # shingles multiplied at a time
COMPARED = 64  # sets compared in a cell for the price of one list entry


def _sets(column):
    """(row, shingle, pointers, signature) of a column's sets; signature 0 if empty."""
    row, key = X.shingles(column)
    pointers = np.searchsorted(row, np.arange(len(column) + 1))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(kernel.mix(key + kernel.MULTIPLIERS[50]), dtype=U64)])
    sums = total[pointers[1:]] - total[pointers[:-1]]
    sizes = np.diff(pointers)
    signature = np.where(sizes > 0, kernel.mix(sums + sizes.astype(U64)), U64(0))
    return row, key, pointers, signature


def signatures(blocked: DataFrame) -> DataFrame:
    """(doc_id, tag, block, n, node): hash of the text, set size and class (null for an empty set)."""
    schema = T.StructType([
        T.StructField("doc_id", blocked.schema["doc_id"].dataType), T.StructField("tag", T.LongType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])

    def sign(batches):
        for whole in batches:
            for batch in kernel.chunks(whole, "text"):
                _, _, pointers, signature = _sets(batch.column("text"))
                n = np.diff(pointers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("tag"), batch.column("block"), pa.array(n),
                     pa.array(signature.view(np.int64), mask=n == 0)], names=schema.names)

    return blocked.withColumn("tag", F.xxhash64("text")).mapInArrow(sign, schema)


def _chosen(docs: pa.Table, wanted: pa.Table):
    """Sets of the block's class representatives: (row, shingle, node of each row)."""
    row, key, pointers, signature = _sets(docs.column("text"))
    nodes = wanted.column("node").to_numpy().astype(np.int64).view(U64)
    mine = np.isin(signature, nodes) & (np.diff(pointers) > 0)
    # One row per class: texts of one set may share a block.
    first = np.unique(np.where(mine, signature, U64(0)), return_index=True)[1]
    pick = np.zeros(len(signature), dtype=bool)
    pick[first] = True
    mine &= pick
    keep = mine[row]
    return row[keep], key[keep], signature


def _ask(bits: int):
    def ask(key, docs, wanted):
        _, shingle, _ = _chosen(docs, wanted)
        distinct, held = np.unique(shingle, return_counts=True)
        if not len(distinct):
            return X.asked(0, [], [])
        shards, ends, bodies = X.pack(distinct, bits)
        extras = []
        for a, b in zip(ends[:-1], ends[1:]):
            more = np.flatnonzero(held[a:b] > 1).astype("<u4")
            extras.append(more.tobytes() + (held[a:b][more] - 1).astype("<u4").tobytes())
        return X.asked(key[0].as_py(), shards, bodies, extras)
    return ask


def _answer(key, table):
    """Classes that hold each shingle, at most 65535, in the order asked."""
    keys = [X.unpack(b) for b in table.column("body").to_pylist()]
    weights = []
    for k, extra in zip(keys, table.column("extra").to_pylist()):
        w = np.ones(len(k))
        more = np.frombuffer(extra, dtype="<u4").reshape(2, -1)
        w[more[0]] += more[1]
        weights.append(w)
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    held = np.minimum(np.bincount(inverse, np.concatenate(weights)), 65535).astype("<u2")
    out, at = [], 0
    for k in keys:
        out.append(held[inverse[at : at + len(k)]].tobytes())
        at += len(k)
    return table.select(["block", "shard"]).append_column("body", pa.array(out, pa.binary()))


_CANDIDATE = "node bigint, n bigint, shareable bigint, short int, keys array<bigint>, members binary"


def _candidates(docs, told):
    """Classes that can be similar to another: prefix shingles and the set."""
    is_answer = pc.is_null(told.column("node"))
    row, shingle, signature = _chosen(docs, told.filter(pc.invert(is_answer)))
    held = X.answers_in_order(told.filter(is_answer), "<u2").astype(np.int64)
    distinct = np.unique(shingle)
    df = held[np.searchsorted(distinct, shingle)] if len(shingle) else held[:0]
    order = np.lexsort((shingle, df, row))
    r, k, f = row[order], shingle[order], df[order]
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, int)
    ends = np.append(starts[1:], len(r))
    out = [[] for _ in range(6)]
    for a, b in zip(starts.tolist(), ends.tolist()):
        n = b - a
        overlap = -(-4 * n // 5)
        first = a + int(np.searchsorted(f[a:b], 2))
        shareable = b - first
        if shareable < overlap:
            continue
        short, long = a + n - overlap + 1, a + min(n, n - overlap + 2)
        prefix = k[first:long]
        if not len(prefix):
            continue
        out[0].append(int(signature[r[a]].view(np.int64)))
        out[1].append(n)
        out[2].append(shareable)
        out[3].append(max(0, short - first))
        out[4].append(prefix.view(np.int64))
        out[5].append(np.sort(k[first:b]).astype("<u8").tobytes())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    names = ["node", "n", "shareable", "short", "keys", "members"]
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)


def candidates(blocked: DataFrame, firsts: DataFrame, bits: int) -> DataFrame:
    by_block = blocked.groupBy("block")
    wanted = firsts.select("block", "node")
    asked = by_block.cogroup(wanted.groupBy("block")).applyInArrow(_ask(bits), X.ASKED)
    answered = asked.groupBy("shard").applyInArrow(_answer, "block int, shard int, body binary")
    told = answered.select("block", "shard", "body", F.lit(None).cast("bigint").alias("node")).unionAll(
        wanted.select("block", F.lit(None).cast("int"), F.lit(None).cast("binary"), "node"))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(_candidates, _CANDIDATE)


def boundary(found: DataFrame) -> int:
    """Size from which scanning lists is cheaper than enumerating 2-subsets."""
    steps = found.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(
        F.min("n").alias("n"), F.sum(F.size("keys") * (F.size("keys") - 1) / 2).alias("light"),
        F.sum(F.col("short") + F.col("scan") / COMPARED).alias("heavy")).orderBy("step").collect()
    best, size, light, heavy = None, 1, 0.0, sum(s["heavy"] for s in steps)
    for s in [*steps, None]:
        if best is None or light + heavy < best:
            best, size = light + heavy, (s["n"] if s else 1 << 62)
        if s:
            light, heavy = light + s["light"], heavy - s["heavy"]
    return size


def _postings(found: DataFrame, size: int) -> DataFrame:
    """(key, node, n, shareable, heavy): entries of the inverted lists."""
    about = ["node", "n", "shareable"]
    heavy = F.col("n") >= size
    near = F.col("n") >= -(-4 * size // 5)  # can be similar to a heavy set
    single = found.where(near).select(
        F.explode(F.slice("keys", F.lit(1), F.col("short"))).alias("key"), *about, heavy.alias("heavy"))
    pairs = F.expr(
        "flatten(transform(sequence(1, size(keys) - 1), i -> "
        "transform(slice(keys, i + 1, size(keys)), y -> xxhash64(keys[i - 1], y))))")
    double = found.where(~heavy & (F.size("keys") > 1)).select(
        F.explode(pairs).alias("key"), *about, F.lit(True).alias("heavy"))
    return single.unionAll(double)


def _fits(a: str, b: str) -> Column:
    """Sizes and shareable shingles allow a similarity of 0.8."""
    col = F.col
    n, m = col(f"{a}.n"), col(f"{b}.n")
    return ((5 * F.least(n, m) >= 4 * F.greatest(n, m))
            & (9 * F.least(col(f"{a}.shareable"), col(f"{b}.shareable")) >= 4 * (n + m)))


def _similar(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets have a similarity of 0.8."""
    def side(name: str, node: str):
        return found.select(F.col("node").alias(node), F.col("n").alias(f"n{name}"),
                            F.col("members").alias(f"s{name}"))

    both = pairs.join(side("u", "u"), "u").join(side("v", "v"), "v").select("u", "v", "nu", "nv", "su", "sv")

    def verify(batches):
        for batch in batches:
            keep = []
            for nu, nv, su, sv in zip(*(batch.column(c) for c in ("nu", "nv", "su", "sv"))):
                a = np.frombuffer(su.as_buffer(), dtype="<u8")
                b = np.frombuffer(sv.as_buffer(), dtype="<u8")
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep.append(100 * common >= 80 * (nu.as_py() + nv.as_py() - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "u bigint, v bigint")


def _distinct_lists(postings: DataFrame) -> DataFrame:
    """Entries of the lists of at least two members, one list per member set.

    Near copies share most of their prefixes, so they meet in hundreds of lists
    of the same members; one of those says it all.
    """
    member = F.xxhash64("node", "heavy").cast("decimal(38,0)")
    lists = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("held"), F.sum(member).alias("s1"),
        F.sum(F.xxhash64(F.lit(7), "node", "heavy").cast("decimal(38,0)")).alias("s2"))
    once = lists.where("held > 1").groupBy("held", "s1", "s2").agg(F.min("key").alias("key"))
    return postings.join(once.select("key"), "key", "left_semi")


def similar_classes(found: DataFrame) -> DataFrame:
    """Links (u, v) that connect all classes that similarity connects."""
    postings = materialize(_distinct_lists(_postings(found, 1)))
    # The first member is one that shares most of its shingles: of near copies,
    # the text they come from, which is closer to each than they are to each other.
    entry = F.struct((1 - F.col("shareable") / F.col("n")).alias("alone"), "node", "n", "shareable")
    lists = postings.groupBy("key").agg(F.min(entry).alias("c"))
    star = postings.alias("p").join(lists.alias("l"), "key").where(
        (F.col("p.node") != F.col("c.node")) & _fits("p", "c"))
    star = star.select(
        F.least("c.node", "p.node").alias("u"), F.greatest("c.node", "p.node").alias("v"))
    star = materialize(star.distinct())
    links = materialize(_similar(star, found))
    known = materialize(connected_components(links))

    still = materialize(_open(found, known))
    postings = materialize(_distinct_lists(_postings(still, boundary(still))))
    meeting = found.join(materialize(_owned(postings, known)), "node").select(
        F.col("owner").alias("component"), "node", "n", "of", "members")
    cross = _cells(meeting).groupBy("component", "low", "up", "i", "j").applyInArrow(_crossing, "u bigint, v bigint")
    return links.unionAll(materialize(cross))


def _open(found: DataFrame, known: DataFrame) -> DataFrame:
    """Classes with those of their prefix shingles that classes of other components
    hold too, in order; ``scan`` counts those others in the lists to scan."""
    about = ["node", "n", "shareable", "short"]
    entries = found.select(*about, "keys").join(known, "node", "left").select(
        *about, F.coalesce("component", "node").alias("of"), F.posexplode("keys").alias("at", "key"))
    counts = entries.groupBy("key", "of").agg(F.count(F.lit(1)).alias("own"))
    others = counts.join(counts.groupBy("key").agg(F.sum("own").alias("held")), "key").select(
        "key", "of", (F.col("held") - F.col("own")).alias("others")).where("others > 0")
    kept = entries.join(others, ["key", "of"]).groupBy(*about).agg(
        F.array_sort(F.collect_list(F.struct("at", "key", "others"))).alias("kept"))
    scanned = F.filter("kept", lambda e: e["at"] < F.col("short"))
    return kept.select(
        "node", "n", "shareable", F.size(scanned).alias("short"),
        F.aggregate(scanned, F.lit(0).cast("bigint"), lambda total, e: total + e["others"]).alias("scan"),
        F.col("kept.key").alias("keys"))


def _owned(postings: DataFrame, known: DataFrame) -> DataFrame:
    """(owner, node, of): classes, with their component, that meet in a list of
    several components, once for each component that owns such a list."""
    placed = materialize(postings.join(known, "node", "left").select(
        "key", "node", "heavy", F.coalesce("component", "node").alias("of")))
    held = placed.groupBy("key", "of").agg(F.count(F.lit(1)).alias("held"), F.max("heavy").alias("heavy"))
    open_lists = held.groupBy("key").agg(
        F.max_by("of", F.struct("held", "of")).alias("owner"), F.count(F.lit(1)).alias("components"),
        F.max("heavy").alias("heavy")).where("components > 1 AND heavy").select("key", "owner")
    return placed.join(open_lists, "key").select("owner", "node", "of").distinct()


def _cells(classes: DataFrame) -> DataFrame:
    """Classes of components, once for each pair (i, j) of cells they belong to.

    A cell is a part of a component or, of a large one, of a band of its sizes;
    a band is wide enough that similar sets lie in one or in adjacent bands.
    """
    parts = F.ceil(F.greatest(
        F.count(F.lit(1)) / CELL_CLASSES, F.sum(F.length("members")) / CELL_BYTES)).cast("int")
    columns = classes.columns
    whole = classes.groupBy("component").agg(parts.alias("whole"))
    band = F.when(F.col("whole") == 1, 0).otherwise(F.floor(F.log(1.3, F.col("n")))).cast("int")
    classes = materialize(classes.join(whole, "component").withColumn("band", band).drop("whole"))
    cells = materialize(classes.groupBy("component", "band").agg(parts.alias("parts")))

    def beside(step: int, name: str):
        return cells.select("component", (F.col("band") - step).alias("band"), F.col("parts").alias(name))

    around = cells.join(beside(1, "above"), ["component", "band"], "left").join(
        beside(-1, "below"), ["component", "band"], "left").na.fill(0, ["above", "below"])
    pairs = F.expr("""concat(
        transform(slice(sequence(0, parts), 1, parts), x -> named_struct(
            'low', band, 'up', 0, 'i', least(part, x), 'j', greatest(part, x), 'side', int(x < part))),
        transform(slice(sequence(0, above), 1, above), x -> named_struct(
            'low', band, 'up', 1, 'i', part, 'j', x, 'side', 0)),
        transform(slice(sequence(0, below), 1, below), x -> named_struct(
            'low', band - 1, 'up', 1, 'i', x, 'j', part, 'side', 1)))""")
    part = F.pmod(F.xxhash64(F.lit(11), "node"), F.col("parts")).cast("int")
    return classes.join(around, ["component", "band"]).withColumn("part", part).select(
        *columns, F.inline(pairs))


def _common(left: list, right: list, same: bool) -> np.ndarray:
    """Numbers of shingles that each left set shares with each right one."""
    sides = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    keys = np.concatenate([*left, *right, np.zeros(0, U64)])
    vocabulary, at = np.unique(keys, return_inverse=True)
    cut, size = len(sides[0]), len(vocabulary)
    held = [np.bincount(x, minlength=size) for x in (at[:cut], at[cut:])]
    shared = held[0] > 1 if same else (held[0] > 0) & (held[1] > 0)
    number = np.cumsum(shared) - 1
    entries = []
    for row, column in zip(sides, (at[:cut], at[cut:])):
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        entries.append((row[order], column[order]))
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(shared.sum()), COLUMNS):
        block = []
        for (row, column), n in zip(entries, common.shape):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            dense = np.zeros((n, COLUMNS), dtype=np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            block.append(dense)
        common += (block[0] @ block[1].T).astype(np.int64)
    return common


def _linked(key, cell, *columns: str):
    """Links of one pair of cells as a matrix, and the columns of either side."""
    same = key[2].as_py() == 0 and key[3].as_py() == key[4].as_py()
    side = cell.column("side").to_numpy()
    left, right = (np.flatnonzero(side == x) for x in (0, 0 if same else 1))
    sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in cell.column("members")]
    n = cell.column("n").to_numpy()
    common = _common([sets[x] for x in left], [sets[x] for x in right], same)
    linked = 100 * common >= 80 * (n[left][:, None] + n[right][None, :] - common)
    if same:
        linked = np.triu(linked, 1)
    values = [cell.column(c).to_numpy() for c in columns]
    return linked, [v[left] for v in values], [v[right] for v in values]


def _pairs(u, v) -> pa.Table:
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def _crossing(key, cell):
    """Links of one pair of cells between components: one of each two components."""
    of = cell.column("of").to_numpy()
    if (of == of[0]).all():
        return _pairs(of[:0], of[:0])
    linked, (u, from_), (v, to) = _linked(key, cell, "node", "of")
    i, j = np.nonzero(linked & (from_[:, None] != to[None, :]))
    ends = np.stack([np.minimum(from_[i], to[j]), np.maximum(from_[i], to[j])])
    first = np.unique(ends, axis=1, return_index=True)[1]
    return _pairs(u[i[first]], v[j[first]])


def _links_of(pairs: bool):
    """Links of one pair of cells: (u, v), or the linked rows of each class."""
    def link(key, cell):
        linked, (u, u_rows), (v, v_rows) = _linked(key, cell, "node", "rows")
        if pairs:
            i, j = np.nonzero(linked)
            return _pairs(u[i], v[j])
        return pa.table({"node": np.concatenate([u, v]),
                         "linked_rows": np.concatenate([linked @ v_rows, u_rows @ linked])})
    return link


def _in_cells(found: DataFrame, firsts: DataFrame, linked: DataFrame, pairs: bool) -> DataFrame:
    schema = "u bigint, v bigint" if pairs else "node bigint, linked_rows bigint"
    classes = found.join(linked, "node").join(firsts.select("node", "rows"), "node").select(
        "component", "node", "n", "rows", "members")
    cells = _cells(classes).groupBy("component", "low", "up", "i", "j")
    return cells.applyInArrow(_links_of(pairs), schema)


def _classes(docs: DataFrame):
    """(rows with their class, classes, candidate classes, components of classes)."""
    rows = docs.select("doc_id", "text")
    size = X.text_size(rows)
    blocked = X.in_blocks(rows, size)
    signed = materialize(signatures(blocked))
    firsts = materialize(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min("block").alias("block"), F.count(F.lit(1)).alias("rows")))
    found = materialize(candidates(blocked, firsts, X.shard_bits(size // 5)))
    return signed, firsts, found, connected_components(similar_classes(found))


def _components(signed: DataFrame, firsts: DataFrame, linked: DataFrame, *more: str) -> DataFrame:
    low = firsts.join(linked, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = firsts.join(linked.join(low, "component"), "node", "left").select(
        "node", F.coalesce("component_id", "first").alias("component_id"), *more)
    return signed.join(of_class, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A document's set holds its distinct 5-word shingles (A-Z lower-cased, words
    are runs without white space), or, of fewer words, its whole sequence; an
    empty set (null text, or no words) is linked with nothing. ``component_id``
    is the smallest id that links of at least 0.8 reach. Rows of one text, or of
    one set, are one class; rows that share an id but not a set keep their own
    classes. An empty table gives an empty table. Other columns are not used.
    """
    signed, firsts, _, linked = _classes(docs)
    return _components(signed, firsts, linked)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """The columns of ``jaccard_components`` and ``n_links`` of every row: how many
    other rows have a similarity of at least 0.8 to it, those of its own set
    included. Every pair counts, also one that a third row connects already."""
    signed, firsts, found, linked = _classes(docs)
    linked = materialize(linked)
    counted = _in_cells(found, firsts, linked, pairs=False).groupBy("node").agg(
        F.sum("linked_rows").alias("linked_rows"))
    firsts = firsts.join(counted, "node", "left").withColumn(
        "n_links", F.col("rows") - 1 + F.coalesce("linked_rows", F.lit(0)))
    return _components(signed, firsts, linked, "n_links").na.fill(0, ["n_links"])


def jaccard_links(docs: DataFrame) -> DataFrame:
    """(u, v, u_rows, v_rows): all pairs of different sets with a similarity of at
    least 0.8, each once, by the smallest id of each set's rows and their number."""
    _, firsts, found, linked = _classes(docs)
    links = _in_cells(found, firsts, materialize(linked), pairs=True)

    def side(x: str):
        return firsts.select(F.col("node").alias(x), F.col("first").alias(f"{x}_id"), F.col("rows").alias(f"{x}_rows"))

    return links.join(side("u"), "u").join(side("v"), "v").select(
        F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"),
        F.when(F.col("u_id") <= F.col("v_id"), F.col("u_rows")).otherwise(F.col("v_rows")).alias("u_rows"),
        F.when(F.col("u_id") <= F.col("v_id"), F.col("v_rows")).otherwise(F.col("u_rows")).alias("v_rows"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component, and all rows of empty sets.

    The row of the smallest id stays (a null id is the largest), of several texts
    under that id the one whose hash is smallest, and of rows that repeat id and
    text the one whose other columns hash lowest.
    """
    signed, _, _, linked = _classes(docs)
    copies = materialize(signed.where("node IS NOT NULL").join(linked, "node", "left").groupBy(
        F.coalesce("component", "node").alias("component"), "doc_id", "tag").agg(F.count(F.lit(1)).alias("rows")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    best = copies.groupBy("component").agg(F.min(place).alias("best"))
    stays = place.eqNullSafe(F.col("best"))
    marked = materialize(copies.join(best, "component").where(~stays | (F.col("rows") > 1)).select(
        F.col("doc_id").alias("copy_id"), F.col("tag").alias("copy_tag"), stays.alias("once")))
    row = docs.select(F.struct(*docs.columns).alias("row"))
    mine = (F.col("row")["doc_id"].eqNullSafe(F.col("copy_id"))
            & (F.xxhash64(F.col("row")["text"]) == F.col("copy_tag")))
    kept = row.join(marked, mine, "left_anti")
    repeated = marked.where("once")
    if not repeated.isEmpty():
        kept = kept.unionAll(row.join(repeated, mine).groupBy("copy_id", "copy_tag").agg(
            F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return kept.select("row.*")
